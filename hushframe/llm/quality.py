"""Quality rules whose thresholds follow from the corpus itself.

Per language and source, mergeable quantile sketches hold the distributions of six
ratios of the documents; thresholds are fences far outside their quartiles, so what is
usual in a source passes there and what stands far out fails. A sketch counts values
in log-linear buckets (ten significant bits), so any quantile of it is exact to within
a 512th of its value; sketches merge by adding counts, in any order and with the same
result. A group's quartiles are drawn towards its language's, and those towards the
whole corpus's, by as much as it has few documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE

SYMBOLS = b"#*$%&|<>"
#: ratio -> (numerator, denominator, units of 1, spread in units that it has at least): columns of ``measure``.
RATIOS = {
    "symbols": ("n_symbols", "word_chars", 1_000_000, 4_000),
    "marks": ("n_marks", "word_chars", 1_000_000, 1_000),
    "dup_lines": ("n_dup_lines", "n_lines", 1_000_000, 40_000),
    "repeats": ("n_repeat_words", "n_words", 1_000_000, 40_000),
    "word_length": ("word_chars", "n_words", 1_000, 20),
    "lines": ("n_lines", "n_words", 1_000_000, 1_000),
}
#: Ratios that have a lower fence too.
BOTH_SIDES = ("word_length",)
#: Significant bits of a sketch's buckets.
BITS = 10
#: A fence is SPREAD times the way from the median to a quartile beyond that quartile; the spread a ratio has
#: at least only counts where a group has next to none. Documents by which a group's quartiles are drawn to the level above.
SPREAD, DRAWN = 10, 50
#: Groups up to which their fences (a row each) are broadcast; parts into which rows are dealt where there are more.
BROADCAST_GROUPS, SALTS = 20_000, 64
MEASURES = "n_words long, word_chars long, n_symbols long, n_marks long, n_lines long, n_dup_lines long, n_repeat_words long"
#: Bytes that are neither white space, ASCII letters nor part of a character above U+007F.
MARKS = bytes(b for b in range(128) if b not in WHITE and not chr(b).isalpha())


def _repeat_words(ids: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """Words of each document in 3-word windows that its text has twice or more."""
    out = np.zeros(docs, np.int64)
    if len(ids) < 3:
        return out
    whole = owner[:-2] == owner[2:]
    start = np.flatnonzero(whole)
    if not len(start):
        return out
    # the windows of all documents are ordered at once: exact comparison, no hashing
    order = np.lexsort((ids[start + 2], ids[start + 1], ids[start], owner[start]))
    s = start[order]
    same = (owner[s[1:]] == owner[s[:-1]]) & (ids[s[1:]] == ids[s[:-1]]) & (ids[s[1:] + 1] == ids[s[:-1] + 1]) & (ids[s[1:] + 2] == ids[s[:-1] + 2])
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[s[twice] + k] = True
    return np.bincount(owner[hit], minlength=docs)


def measures(texts: list[bytes]) -> list[np.ndarray]:
    """The columns of MEASURES for some texts (UTF-8)."""
    words = [t.split() for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64, int(n_words.sum()))
    owner = np.repeat(np.arange(len(texts)), n_words)
    chars, symbols, marks, lines, dups = [], [], [], [], []
    for t in texts:
        bare = t.translate(None, WHITE)
        chars.append(len(bare) if bare.isascii() else len(bare.decode()))
        symbols.append(len(bare) - len(bare.translate(None, SYMBOLS)))
        marks.append(len(bare) - len(bare.translate(None, MARKS)))
        own = [x for x in t.split(b"\n") if x.strip()]
        lines.append(len(own))
        dups.append(len(own) - len(set(own)))
    return [n_words, np.array(chars, np.int64), np.array(symbols, np.int64), np.array(marks, np.int64), np.array(lines, np.int64), np.array(dups, np.int64), _repeat_words(ids, owner, len(texts))]


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and MEASURES for every row; a null text has no words."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`k{i}` {f.dataType.simpleString()}" for i, f in enumerate(fields)), MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = measures([x or b"" for x in part.column(len(fields)).cast(pa.binary()).to_pylist()])
                names = [*(f"k{i}" for i in range(len(fields))), *(m.split()[0] for m in MEASURES.split(", "))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, got)], names=names)

    out = docs.select(*(docs[c].alias(f"k{i}") for i, c in enumerate(keep)), docs[text].alias("t")).mapInArrow(run, schema)
    return out.toDF(*keep, *(m.split()[0] for m in MEASURES.split(", ")))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def value_of(ratio: str) -> Column:
    """The ratio in its units, rounded down; 0 where there is nothing to divide by."""
    top, bottom, units, _ = RATIOS[ratio]
    return F.when(F.col(bottom) > 0, F.expr(f"({units} * {top}) div {bottom}")).otherwise(0).cast("long")


def bucket_of(value: Column) -> Column:
    """The least value of a value's bucket: its first BITS binary digits."""
    cut = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, cut), cut)


def sketch(measured: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Sketches: a row for each group, ratio and bucket in use, with its count, over documents that have words.

    Counts are added in each task before anything is exchanged; the buckets of a ratio
    grow with the logarithm of its greatest value, not with the documents.
    """
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("ratio"), bucket_of(value_of(r)).alias("bucket")) for r in RATIOS)))
    return measured.filter("n_words > 0").select(*groups, each.alias("m")).groupBy(*groups, "m.ratio", "m.bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketches: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """docs, q1, q2 and q3 of each group and ratio."""
    w = Window.partitionBy(*groups, "ratio")
    run = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    merged = sketches.groupBy(*groups, "ratio", "bucket").agg(F.sum("n").alias("n"))
    ranked = merged.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(run))
    at = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("bucket"))).cast("double").alias(f"q{q}")
    return ranked.groupBy(*groups, "ratio").agg(F.max("total").alias("docs"), at(1), at(2), at(3))


def thresholds(measured: DataFrame, groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """One row a group: the upper fence of each ratio, and the lower one of those in BOTH_SIDES."""
    first = groups[0]
    own = sketch(measured, groups)
    quarters = ("q1", "q2", "q3")
    whole = quartiles(own.withColumn("_all", F.lit(1)), ("_all",)).select(F.col("ratio").alias("_r"), *(F.col(q).alias(f"{q}_0") for q in quarters))
    drawn = lambda q, level, docs="docs": ((F.col(docs) * F.col(q) + DRAWN * F.col(f"{q}_{level}")) / (F.col(docs) + DRAWN))
    middle = quartiles(own, (first,)).join(whole, F.col("ratio") == F.col("_r")).select(F.col(first).alias("_f"), F.col("ratio").alias("_r"), *(drawn(q, 0).alias(f"{q}_1") for q in quarters))
    fine = quartiles(own, groups).join(middle, F.col(first).eqNullSafe(F.col("_f")) & (F.col("ratio") == F.col("_r")))
    fine = fine.select(*groups, "ratio", *(drawn(q, 1).alias(q) for q in quarters))
    least = F.coalesce(*(F.when(F.col("ratio") == r, F.lit(float(x[3]))) for r, x in RATIOS.items()))
    high = F.col("q3") + SPREAD * F.greatest(F.col("q3") - F.col("q2"), least)
    low = F.col("q1") - SPREAD * F.greatest(F.col("q2") - F.col("q1"), least)
    of = lambda r, c: F.max(F.when(F.col("ratio") == r, c))
    return fine.groupBy(*groups).agg(*(of(r, high).alias(f"max_{r}") for r in RATIOS), *(of(r, low).alias(f"min_{r}") for r in BOTH_SIDES))


def with_fences(measured: DataFrame, limit: DataFrame, groups: tuple[str, str]) -> DataFrame:
    """``measured`` with its group's fences; ``limit`` is a written table of a row a group.

    A group may hold a third of all rows: it is never dealt to one task. Few groups
    are broadcast; of many, the fences are repeated and the rows dealt into parts.
    """
    named = limit.withColumnsRenamed({g: f"_of{i}" for i, g in enumerate(groups)})
    same = F.col(groups[0]).eqNullSafe(F.col("_of0")) & F.col(groups[1]).eqNullSafe(F.col("_of1"))
    if limit.count() <= BROADCAST_GROUPS:
        return measured.join(F.broadcast(named), same, "left")
    named = named.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("n_words", "word_chars", "n_marks", "n_lines"), F.lit(SALTS)).cast("int")
    return measured.withColumn("_salt", salt).join(named, same & (F.col("_salt") == F.col("_part")), "left")


def within_fences() -> Column:
    """Whether no ratio is outside its fences; a document without words has none to be outside of."""
    ok = F.lit(True)
    for r in RATIOS:
        ok = ok & (value_of(r) <= F.col(f"max_{r}"))
    for r in BOTH_SIDES:
        ok = ok & (value_of(r) >= F.col(f"min_{r}"))
    return F.coalesce((F.col("n_words") == 0) | ok, F.lit(True))


def judge(docs: DataFrame, keep: list[str], groups: tuple[str, str] = ("lang", "source"), text: str = "text") -> DataFrame:
    """Measures, base_failed and kept for every row of ``docs``, with the columns ``keep``.

    kept: base_failed is false and no ratio is outside its group's fences. Null
    languages and sources form groups of their own. The rows are measured once, into
    a table in the shared folder; the thresholds (a row a group) are then joined.
    Repeated rows count, and are returned, each; an empty table gives an empty one. A
    null text has no words, and fails by that. Texts are measured whole, however long.
    """
    from .common import written

    keep = list(dict.fromkeys([*keep, *groups]))
    measured = written(measure(docs, keep, text), "quality-measures")
    limit = written(thresholds(measured, groups), "quality-fences")
    joined = with_fences(measured, limit, groups)
    return joined.select(*measured.columns, base_failed().alias("base_failed"), (~base_failed() & within_fences()).alias("kept"))


def kept_rows(docs: DataFrame, groups: tuple[str, str] = ("lang", "source"), text: str = "text") -> DataFrame:
    """``docs`` without the rows that are judged to fail.

    The rows are measured twice: for the sketches, and again beside their texts, so
    that texts need neither be exchanged nor written in between.
    """
    from .common import apart, written

    plain, (t, first, second) = apart(docs, text, *groups)
    by = (first, second)
    limit = written(thresholds(measure(plain, list(by), t), by), "quality-fences")
    joined = with_fences(measure(plain, plain.columns, t), limit, by)
    return joined.filter(~base_failed() & within_fences()).select(*plain.columns).toDF(*docs.columns)
