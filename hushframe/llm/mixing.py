"""Mixing sources to target weights by capped water-filling.

All sources share out the size of the whole input by weight, but none above
``max_epochs`` times its own size; what a clamped source can't take goes to the
others by weight, until nothing is above. Then each source is taken in whole
repetitions of its documents and one seeded fractional repetition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, "mix-1"
#: Hash buckets of a source: the first three of the 32 hexadecimal digits.
DIGITS = 3
#: Sources up to which the plan (a row a source) is broadcast, so that no text is exchanged; parts into
#: which a source's rows are dealt where there are more.
BROADCAST_SOURCES, SALTS = 20_000, 64


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target for a table of (source, source_size), one row a source.

    The level of the water is found in closed form: in ascending order of
    size / weight the first k sources are clamped, the rest share what is left; k is
    the first for which the next source fits under its cap. Windows over all rows
    here see one row a source.
    """
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    numbered = sizes.withColumn("_n", F.row_number().over(by_name))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.lit(max_epochs) * F.col("source_size")
    each = numbered.withColumn("_w", weight.cast("long")).withColumn("_cap", cap)
    order = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), "_n")
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(above), F.lit(0))) / F.sum("_w").over(rest)
    leveled = each.withColumn("_level", level).withColumn("_fits", F.col("_cap") >= F.col("_w") * F.col("_level"))
    final = F.min(F.when(F.col("_fits"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_n").alias("n"), F.col("_level").alias("level")))).over(whole)["level"]
    water = leveled.withColumn("_final", final)
    target = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_w") * F.col("_final"), F.col("_cap")))
    return water.select(source, "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, copies (whole repetitions of a row) and part.

    Every row of a source is taken floor(target / source_size) times; the rest of the
    target is filled with its rows in the order of a seeded hash of the key. The row
    at which the target is met has in ``part`` how many of its words still fit (0 in
    all others), so a source's words are its target's to within a word. To find where the order ends, sizes are added up by source and
    hash bucket (4,096 rows a source at most, whatever its rows); only the documents
    of the one bucket where it ends are ordered, so a hot source isn't sorted in one
    task. Rows without words are taken as often as the whole repetitions. A null
    source is a source of its own, the last; columns of ``docs`` that are named like
    the added ones are left out; a null text has no words; equal rows
    differ in nothing, so either may be taken. Reruns agree.
    """
    from .common import apart, scratch, written

    theirs = docs.columns
    docs, (text, source, key) = apart(docs, text, source, key)
    hashed = F.md5(F.concat_ws("/", F.lit(seed), F.col(key).cast("string")))
    sized = docs.withColumn("size", size_of(text)).withColumn("_hash", hashed).withColumn("_bucket", F.substring("_hash", 1, DIGITS))
    slim = sized.select(F.col(source).alias("_source"), F.col(key).alias("_key"), "size", "_hash", "_bucket")
    path = scratch(docs.sparkSession, "mix-sizes")
    slim.write.parquet(path)
    slim = docs.sparkSession.read.schema(slim.schema).parquet(path)

    buckets = slim.groupBy("_source", "_bucket").agg(F.sum("size").alias("_size"))
    sizes = buckets.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    plan = targets(sizes, "_source", weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("_whole", whole).withColumn("_open", F.col("target") - F.col("_whole") * F.col("source_size"))
    plan = plan.withColumnRenamed("_source", "_plan_source")
    same_source = F.col("_source").eqNullSafe(F.col("_plan_source"))

    # the bucket of each source in which its fractional repetition ends
    upto = Window.partitionBy("_plan_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    run = buckets.join(plan, same_source).withColumn("_before", F.coalesce(F.sum("_size").over(upto), F.lit(0)))
    end = run.filter(F.col("_before") <= F.col("_open")).groupBy("_plan_source").agg(F.max_by(F.struct("_bucket", "_before"), "_bucket").alias("_end"))
    plan = plan.join(end.withColumnRenamed("_plan_source", "_end_source"), F.col("_plan_source").eqNullSafe(F.col("_end_source")), "left")
    plan = plan.select("_plan_source", "source_size", "target", "_whole", "_open", F.col("_end._bucket").alias("_last"), F.col("_end._before").alias("_before"))

    # inside that bucket, the first document in the order of the hash that doesn't fit whole
    inside = slim.join(plan, same_source & (F.col("_bucket") == F.col("_last")))
    order = Window.partitionBy("_source").orderBy("_hash", "_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto_here = inside.withColumn("_upto", F.col("_before") + F.sum("size").over(order))
    met = F.struct("_hash", "_key", "size", F.round(F.col("_open") - F.col("_upto") + F.col("size")).cast("long").alias("part"))
    cut = upto_here.filter(F.col("_upto") > F.col("_open")).groupBy("_source").agg(F.min(met).alias("_cut")).withColumnRenamed("_source", "_cut_source")
    plan = plan.join(cut, F.col("_plan_source").eqNullSafe(F.col("_cut_source")), "left").drop("_cut_source")

    plan = written(plan, "mix-plan")
    dealt = sized.withColumn("_source", F.col(source))
    if plan.count() <= BROADCAST_SOURCES:
        joined = dealt.join(F.broadcast(plan), same_source, "left")
    else:
        # a source may hold a third of all rows: its plan is repeated, its rows are dealt into parts
        salted = plan.withColumn("_plan_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = dealt.withColumn("_salt", F.pmod(F.xxhash64(F.col(key), "_hash"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, same_source & (F.col("_salt") == F.col("_plan_salt")), "left")
    place, mark = F.struct(F.col("_hash"), F.col(key).alias("_key"), F.col("size")), F.struct("_cut._hash", "_cut._key", "_cut.size")
    before = (F.col("_bucket") < F.col("_last")) | ((F.col("_bucket") == F.col("_last")) & (F.col("_cut").isNull() | (place < mark)))
    extra = F.when((F.col("size") > 0) & F.coalesce(before, F.lit(False)), 1).otherwise(0)
    copies = F.coalesce(F.col("_whole"), F.lit(0)) + extra
    part = F.when(F.coalesce((F.col("_bucket") == F.col("_last")) & (place == mark), F.lit(False)), F.col("_cut.part")).otherwise(0)
    added = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": copies.cast("int"), "part": part.cast("long")}
    return joined.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, theirs, strict=True) if n not in added), *(c.alias(n) for n, c in added.items()))


def repeated(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The mix as whole rows of ``docs``, each as often as it is taken.

    The row of a source at which its target is met is taken once more if more than
    half of it fits.
    """
    from .common import apart

    plain, (text, source, key) = apart(docs, text, source, key)
    mixed = mix(plain, text, source, key, **options)
    times = F.col("copies") + F.when(2 * F.col("part") > F.col("size"), 1).otherwise(0)
    each = mixed.withColumn("_times", times.cast("int")).filter("_times > 0")
    return each.withColumn("_time", F.explode(F.expr("sequence(1, _times)"))).select(*plain.columns).toDF(*docs.columns)
