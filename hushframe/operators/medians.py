"""Exact medians of groups of any size: no task holds a group's values."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

#: Values of a group and column that one task may put in order, and parts that a range is divided into.
MOST, PARTS = 1 << 16, 1 << 12
#: Rows (a few numbers each) up to which a table of groups is broadcast; larger ones are joined by exchange.
SENT = 1 << 20


def plain(column: str | Column) -> Column:
    """Spark's own median, which counts a group's values in one task."""
    return F.median(column)


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[f"_{k}"]) for k in keys))


def _aside(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_{k}" for k in keys})


def _long(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """keys, _name, _v, _c: how often a group has a value of a column; nulls don't count."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.col(n).cast("double").alias("v")) for n in names)))
    long = df.select(*keys, each.alias("_e")).select(*keys, F.col("_e.n").alias("_name"), F.col("_e.v").alias("_v")).filter(F.col("_v").isNotNull())
    return long.groupBy(*keys, "_name", "_v").agg(F.count(F.lit(1)).alias("_c"))


def _picked(counts: DataFrame, on: Sequence[str], order: str) -> DataFrame:
    """Rows of ``counts`` (with _c, and ranks _r wanted of their group) that hold a wanted rank, with the rank inside the row."""
    upto = F.sum("_c").over(Window.partitionBy(*on, "_r").orderBy(order))
    return counts.withColumn("_upto", upto).filter((F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_c"))).withColumn("_r", F.col("_r") - F.col("_upto") + F.col("_c")).drop("_upto")


def selected(df: DataFrame, keys: Sequence[str], names: Sequence[str], keep: Callable[[DataFrame, str], DataFrame], most: int = MOST, parts: int = PARTS, groups: int = 0) -> DataFrame:
    """keys, _name, _median of every group and column, by selection.

    Equal values are counted in the tasks and dealt out by value, so a group is spread
    over all tasks. A group's range is divided into ``parts``; the counts of the parts
    (a row each) tell the part that a rank lies in, whose own least and greatest value
    are the range of the next round, until a part holds one value, or no more than
    ``most`` that can be put in order. Of an even number of values the mean of the two
    middle ones is taken, as usual. ``keep`` writes narrow tables between rounds;
    ``groups`` is how many groups there are, if that is known.
    """
    sent = F.broadcast if 0 < 2 * groups * len(names) <= SENT else lambda x: x
    on = [*keys, "_name"]
    values = keep(_long(df, keys, names), "values")
    finite = ~(F.isnan("_v") | F.col("_v").isin(float("inf"), float("-inf")))
    edges = (F.min(F.when(finite, F.col("_v"))).alias("_a"), F.max(F.when(finite, F.col("_v"))).alias("_b"), F.count(F.lit(1)).alias("_d"), F.sum("_c").alias("_c"))
    whole = values.groupBy(*on).agg(*edges)
    ranks = F.array_distinct(F.array(F.floor((F.col("_c") - 1) / 2), F.floor(F.col("_c") / 2)))
    n = F.size(ranks)
    # one row a wanted rank: _r counts within the values from _lo to _hi
    wanted = whole.select(*on, n.alias("_ranks"), F.explode(F.transform(ranks, lambda r, i: F.struct(r.alias("r"), i.alias("i")))).alias("_x"), "_a", "_b", "_d").select(*on, "_ranks", F.col("_x.i").alias("_i"), F.col("_x.r").alias("_r"), "_a", "_b", "_d", F.lit(float("-inf")).alias("_lo"), F.lit(float("nan")).alias("_hi"))
    wanted = keep(wanted, "wanted")
    found = None
    while True:
        done = wanted.filter(F.col("_d") <= most)
        rest = wanted.filter(F.col("_d") > most)
        within = lambda w: values.join(sent(_aside(w, on)), reduce(lambda x, y: x & y, (values[k].eqNullSafe(F.col(f"_{k}")) for k in on)) & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        small = _picked(within(done).select(*on, "_i", "_ranks", "_r", "_v", "_c"), [*on, "_i"], "_v").select(*on, "_ranks", "_v")
        found = small if found is None else found.unionByName(small)
        if rest.isEmpty():
            break
        # halves, so that a range between numbers of opposite sign doesn't overflow
        width = F.col("_b") / 2 - F.col("_a") / 2
        part = F.when(F.isnan("_v"), parts + 1).when(F.col("_v") > F.col("_b"), parts).when(F.col("_v") < F.col("_a"), -1).when(width > 0, F.least(F.floor((F.col("_v") / 2 - F.col("_a") / 2) / width * parts), F.lit(parts - 1))).otherwise(0)
        dealt = within(rest).withColumn("_part", part.cast("int"))
        cells = dealt.groupBy(*on, "_i", "_ranks", "_r", "_part").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *edges)
        wanted = keep(_picked(cells, [*on, "_i"], "_part").select(*on, "_ranks", "_i", "_r", F.coalesce("_a", "_lo").alias("_a"), F.coalesce("_b", "_hi").alias("_b"), "_d", "_lo", "_hi"), "wanted")
    return found.groupBy(*on).agg((F.sum("_v") / F.count(F.lit(1))).alias("_median"))


def larger(df: DataFrame, keys: Sequence[str], keep: Callable[[DataFrame, str], DataFrame], most: int = MOST) -> DataFrame:
    """Keys of groups of more than ``most`` rows."""
    return keep(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > most).select(*keys), "large")


def plains(names: Sequence[str], prefix: str = "median_") -> list[Column]:
    return [plain(F.col(n).cast("double")).alias(f"{prefix}{n}") for n in names]


def medians(df: DataFrame, keys: Sequence[str], names: Sequence[str], keep: Callable[[DataFrame, str], DataFrame], most: int = MOST, parts: int = PARTS, prefix: str = "median_") -> DataFrame:
    """keys and a median of each of ``names``: groups of up to ``most`` rows in a task each, larger ones by selection.

    Null keys make groups of their own; a group without values has a null.
    """
    large = larger(df, keys, keep, most)
    direct = lambda x: x.groupBy(*keys).agg(*plains(names, prefix))
    groups = large.count()
    if not groups:
        return direct(df)
    apart = _aside(large, keys)
    apart = F.broadcast(apart) if groups <= SENT else apart
    rest = direct(df.join(apart, _same(df, apart, keys), "left_anti"))
    told = selected(df.join(apart, _same(df, apart, keys), "left_semi"), keys, names, keep, most, parts, groups)
    wide = told.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == n, F.col("_median"))).alias(f"{prefix}{n}") for n in names))
    # a large group none of whose columns has a value
    told = _aside(wide, keys)
    return rest.unionByName(large.join(told, _same(large, told, keys), "left").drop(*(f"_{k}" for k in keys)))


def counted(df: DataFrame, name: str, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, int]:
    """``df`` kept, and how many rows it has, counted while it is written."""
    seen = Observation()
    return keep(df.observe(seen, F.count(F.lit(1)).alias("n")), name), seen.get["n"]


def rolled_up(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], names: Sequence[str], keep: Callable[[DataFrame, str], DataFrame], most: int = MOST, rows: int | None = None) -> DataFrame:
    """``aggregates`` and ``medians`` of the groups: in one pass where no group is large.

    ``rows``, if known: no group is larger than all together.
    """
    if (rows is not None and rows <= most) or larger(df, keys, keep, most).isEmpty():
        return df.groupBy(*keys).agg(*aggregates, *plains(names))
    out, told = df.groupBy(*keys).agg(*aggregates), _aside(medians(df, keys, names, keep, most), keys)
    return out.join(told, _same(out, told, keys)).drop(*(f"_{k}" for k in keys))
