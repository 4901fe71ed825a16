"""The registered queries of the corpus operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, scratch, table
from .oracle import ORACLE_SQL  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, fold("doc_id", 5) > 0)
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_trie

    learned = fold("doc_id", 7)
    out = ngram_trie.score(table(spark, sf_dir, "documents"), learned != 2)
    return out.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.join(table(spark, sf_dir, "documents"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import simple8b

    path = scratch(spark, "token-ids")
    simple8b.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return simple8b.read_ids(spark, path, digest=True).withColumnRenamed("key", "doc_id")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pq

    return pq.link(table(spark, sf_dir, "embeddings"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    learned = fold("doc_id", 4)
    profiles = langid.fit(langid.training_sample(docs, (learned >= 0) & (learned != 2)))
    out = langid.predict(docs, profiles, ["doc_id"])
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_text

    return html_text.extract_pages(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    out = quality.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size") + F.col("part")).alias("taken"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    out = suffix_dedup.dedup(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import filter_audit

    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fim

    out = fim.transform(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_toxicity, op2_byte_bpe, op3_lm_score, op4_ngram_join, op5_token_ids, op6_embeddings, op7_language, op8_html, op9_quality, op10_mixing, op11_suffix_dedup, op12_filter_audit, op13_fill_in_middle)}
