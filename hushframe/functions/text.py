"""Column functions on single strings."""

from __future__ import annotations

import hashlib
import hmac as _hmac
import string
import uuid
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folding import fold

#: The notations in the order in which ties are broken, with the markers that count against each.
NOTATIONS = (("xml", ("<", "</")), ("bracket", ("[[", "]]")), ("paren", ("((SENSITIVE:", "))")), ("sentinel", ("<<SENSITIVE:", "<</SENSITIVE:")))
#: Upper ends of the size buckets.
BUCKETS = ((1, "0"), (128, "1-127"), (512, "128-511"), (2048, "512-2047"), (8192, "2048-8191"))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named there (in a lambda, once an element otherwise)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space (any of Unicode's) at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def count_of(text: Column, needle: str) -> Column:
    """How often a literal occurs, not counting overlaps."""
    some = ((F.length(text) - F.length(F.replace(text, F.lit(needle)))) / len(needle)).cast("int")
    return F.when(~F.contains(text, F.lit(needle)), F.lit(0)).otherwise(some)


def tag_notation(text: Column | str) -> Column:
    """The notation whose markers the text has least of."""
    text = col(text)
    scored = [F.struct(reduce(lambda a, b: a + b, (count_of(text, m) for m in marks)).alias("n"), F.lit(i).alias("rank"), F.lit(name).alias("name")) for i, (name, marks) in enumerate(NOTATIONS)]
    return F.array_min(F.array(*scored))["name"]


def entity_tag(value: Column, label: Column, notation: Column) -> Column:
    forms = {
        "xml": F.concat(F.lit("<"), label, F.lit(">"), value, F.lit("</"), label, F.lit(">")),
        "bracket": F.concat(F.lit("[["), value, F.lit("|"), label, F.lit("]]")),
        "paren": F.concat(F.lit("((SENSITIVE:"), label, F.lit("|"), value, F.lit("))")),
        "sentinel": F.concat(F.lit("<<SENSITIVE:"), label, F.lit(">>"), value, F.lit("<</SENSITIVE:"), label, F.lit(">>")),
    }
    return F.coalesce(*(F.when(notation == k, v) for k, v in forms.items()))


def redaction_label(label: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(strip(label), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.upper(F.when(clean == "", F.lit("UNKNOWN")).otherwise(clean))


def check_template(template: str, required: set[str], allowed: set[str]) -> None:
    fields = {name for _, name, _, _ in string.Formatter().parse(template) if name}
    if fields - allowed:
        raise ValueError(f"placeholders not supported here: {', '.join(sorted(fields - allowed))}")
    if required - fields:
        raise ValueError(f"placeholders missing: {', '.join(sorted(required - fields))}")


def filled(template: str, **values: Column) -> Column:
    """A checked template as one concatenation: what is filled in isn't scanned again."""
    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(values[name])
    return F.concat(*parts) if parts else F.lit("")


def digest(value: Column, algorithm: str = "sha256") -> Column:
    data = value.cast("binary")
    return {"sha256": F.sha2(data, 256), "sha1": F.sha1(data), "md5": F.md5(data)}[algorithm]


def size_bucket(n: Column) -> Column:
    return F.coalesce(*(F.when(n < top, F.lit(name)) for top, name in BUCKETS), F.lit("8192+"))


def word_count(text: Column) -> Column:
    """Runs of other than white space; the default token count."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def value_key(value: Column) -> Column:
    return fold(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")))


def edge_is_word(needle: Column, last: bool = False) -> Column:
    return needle.rlike(r"[\p{L}\p{N}_]$" if last else r"^[\p{L}\p{N}_]")


def quoted(needle: Column) -> Column:
    """A literal as part of a regular expression."""
    return F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def needle_pattern(needle: Column) -> Column:
    """Matches the literal in any case, between ASCII word boundaries where its own edges are word characters."""
    before = F.when(edge_is_word(needle), F.lit("(?<![A-Za-z0-9_])")).otherwise("")
    after = F.when(edge_is_word(needle, last=True), F.lit("(?![A-Za-z0-9_])")).otherwise("")
    return F.concat(F.lit("(?iu)"), before, quoted(needle), after)


def occurrences(text: Column, needle: Column) -> Column:
    """Starts (code points, from 0) of all occurrences of a literal; none for an empty one.

    Lengths of the pieces between the matches are added up, as a JVM regex's own
    offsets aren't code points.
    """
    none = F.array().cast("array<int>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def walked(pieces: Column) -> Column:
        step = lambda acc, p: F.struct((acc["at"] + F.length(p) + F.length(needle)).alias("at"), F.array_append(acc["out"], acc["at"] + F.length(p)).alias("out"))
        return F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), zero, step)["out"]

    return F.when(F.length(needle) > 0, bound(F.split(text, needle_pattern(needle), -1), walked)).otherwise(none)


def contains_value(output: Column, value: Column) -> Column:
    """Whether a text still has a value: short ones and digits need edges that aren't letters or digits."""
    bounded = F.concat(F.lit(r"(?<![\p{L}\p{N}])"), quoted(value), F.lit(r"(?![\p{L}\p{N}])"))
    strict = (F.length(value) <= 4) | value.rlike(r"^\p{Nd}+$")
    return F.when(strict, F.rlike(output, bounded)).otherwise(F.contains(output, value))


#: How API keys begin (in any case).
KEY_STARTS = (r"sk-", r"sk_", r"sk-ant-", r"sk-proj-", r"ghp_", r"pat-", r"hf_", r"xox[a-z]-", r"ya29\.", r"aiza", r"akia", r"bearer\s+")


def looks_like_key(value: Column) -> Column:
    """A known beginning, or 20 characters (without separators) with a letter and a digit among them."""
    compact = F.regexp_replace(strip(value), r"[\s'\";:,/]+", "")
    known = strip(value).rlike("(?i)^(" + "|".join(KEY_STARTS) + ")")
    return known | ((F.length(compact) >= 20) & compact.rlike("[A-Za-z]") & compact.rlike("[0-9]"))


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """Version 5 UUID of a name, 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    high = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.substring(F.lit("89ab"), F.pmod(high, F.lit(4)) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def record_id(*columns: Column | str) -> Column:
    """Id of a record from the canonical JSON of the columns that name it."""
    return uuid5(F.to_json(F.struct(*map(col, columns)), {"ignoreNullFields": "false"}))


def keyed_hash(text: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex. The key's pads are literals of the plan: use a key for one run only."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    inner, outer = (bytes(b ^ pad for b in key.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), text.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def keyed_hash_of(text: str, key: bytes) -> str:
    return _hmac.new(key, text.encode(), hashlib.sha256).hexdigest()


def ratio(top: Column, bottom: Column) -> Column:
    """Null unless the denominator is above 0."""
    return F.when(bottom > 0, top.cast("double") / bottom)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall))
