"""The registered queries of the corpus operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import table
from .sql import ORACLES


def held_out(id: str, parts: int, rest: int):
    return F.crc32(F.col(id).cast("string").cast("binary")) % parts == rest


def op1_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .likelihood import score_likelihood

    return score_likelihood(table(spark, sf_dir, "documents"), ~held_out("doc_id", 7, 2))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_dedup_digest

    return line_dedup_digest(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import substring_digest

    return substring_digest(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), c["contaminated"].alias("contaminated"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by labels whose crc32(doc_id as text) mod 5 is not 0; the others test it (``held_out``)."""
    from .cotraining import quality_scores

    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)))
    return scores.withColumn("held_out", held_out("doc_id", 5, 0))


def op6_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import audio_digest

    return audio_digest(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1)))
    score = F.col("toxicity")
    return score_toxicity(docs, machine).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import codec_digest

    return codec_digest(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_digest

    return pii_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
