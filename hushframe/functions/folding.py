"""Full case folding as a column expression: characters that fold to several included."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters beyond ASCII with what they fold to, by Python's tables: to one character, and to several.
_FOLDED = {c: c.casefold() for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.casefold() != c}
ONE = {c: f for c, f in _FOLDED.items() if len(f) == 1}
SEVERAL = {c: f for c, f in _FOLDED.items() if len(f) > 1}
_ANY = "[" + "".join(SEVERAL) + "]"


def fold(text: Column) -> Column:
    """``text`` as it is compared whatever its case: sharp s is ss, both small sigmas are one, dotted I is i and a dot.

    ASCII, which most values are, takes one ``lower``.
    """
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SEVERAL.items()))
    wide = F.when(text.rlike(_ANY), F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["a"], p["b"]))).otherwise(text)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(F.translate(wide, letters + "".join(ONE), letters.lower() + "".join(ONE.values())))
