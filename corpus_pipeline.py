"""A training corpus from ``documents``: tell languages, apply quality rules, drop near-duplicates, mix sources, encode.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns a DataFrame; all but the last return the columns of ``documents``. Stages take
texts whole, however long; an empty table gives an empty one; columns that are named
like one of ours stay as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hushframe.llm import bpe, langid, mixing, ngram_join, quality
from hushframe.llm.common import fold, scratch, table, written

#: Cosine below which no language is told: three times the noise of unrelated vectors.
LEAST_COSINE = 0.1


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose language can't be told: a null text, one without a letter, or no profile near.

    Profiles are learned from rows with text and language; without any, no language
    can be told and no row stays. Of equal cosines the language first by code point
    wins; repeated rows stay or go alike.
    """
    learned = fold("doc_id", 4)
    profiles = langid.fit(langid.training_sample(docs, (learned >= 0) & (learned != 2)))
    return langid.told_rows(docs, profiles, LEAST_COSINE)


def apply_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that the quality rules reject: null, empty and short texts, and those outside their group's fences.

    Null languages and sources are groups of their own. A value at a fence is inside
    it; repeated rows count each and stay or go alike.
    """
    return quality.kept_rows(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one row of each class of near-duplicates, that of the smallest id.

    Texts that are null or have no words link with nothing and stay, as do rows
    without an id. Rows that repeat an id that stays are reduced to one.
    """
    return ngram_join.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops rows so that sources come to their target weights.

    A null source is one of its own, the last. Rows without words (null texts too) are
    taken as often as their source's whole repetitions. Rows are ordered by a seeded
    hash of their ids; of rows with the same, either may be taken.
    """
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of what they decode to.

    A null text is an empty one, with no ids; repeated rows give repeated rows, and a
    null id stays null.
    """
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("language", tell_language), ("quality", apply_quality), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("byte_bpe", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    name, last = STAGES[-1]
    path = scratch(spark, f"stage-{name}")
    last(spark, docs, sf_dir).write.parquet(path)
    return spark.read.parquet(path)
