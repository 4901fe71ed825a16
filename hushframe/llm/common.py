"""What the corpus operators share: tables, folds, the shared folder, samples."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six (space and 0x09-0x0D).
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; -1 for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % modulus, F.lit(-1)).cast("int")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    Read from ``spark.checkpoint.dir``; where that is unset in a local session, as in
    tests, a folder of our own is set. On a cluster it is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        conf = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not conf:
        got = jsc.getCheckpointDir()
        conf = got.get() if got.isDefined() else None
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        conf = "/tmp/checkpoints/hushframe"
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: read back, its lineage cut."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, stratum: str, per_stratum: int, key: str, seed: int) -> DataFrame:
    """At most ``per_stratum`` rows of each value of ``stratum``, the first by a seeded hash.

    The strata are counted first (in each task before anything is exchanged); then only
    rows whose hash is below a bound at which a quarter more than ``per_stratum`` are
    expected are ordered, so what meets in one task grows neither with the rows nor
    with the partitions. There is one row a stratum (labels, languages), of which
    callers hold a model each; that is what is broadcast.
    """
    from pyspark.sql import Window

    span = 1 << 30
    counts = df.groupBy(F.col(stratum).alias("_stratum")).agg(F.count(F.lit(1)).alias("_rows"))
    bound = counts.select("_stratum", F.least(F.ceil(F.lit(1.25 * per_stratum * span) / F.col("_rows")), F.lit(span)).alias("_bound"))
    order = F.xxhash64(F.lit(seed), F.col(key))
    near = df.join(F.broadcast(bound), df[stratum] == F.col("_stratum")).filter(F.pmod(order, F.lit(span)) < F.col("_bound")).select(*df.columns)
    w = Window.partitionBy(stratum).orderBy(F.pmod(order, F.lit(span)), order, F.col(key))
    return near.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= per_stratum).drop("_rank")


def apart(df: DataFrame, *named: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named _c0, _c1, ... and the new names of ``named``: no name can clash with one of ours."""
    names = [f"_c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), [names[df.columns.index(c)] for c in named]
