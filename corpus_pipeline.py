"""The corpus pipeline: toxicity, line dedup, near-duplicate documents, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
documents. Rows with null text go through every stage: they are not toxic, have no lines, are no
duplicates and encode to no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm._tables import own_columns, stash, table
from tagloom.llm.decontaminate import decontaminate
from tagloom.llm.jaccard import jaccard_components
from tagloom.llm.lines import dedup_lines
from tagloom.llm.sentencepiece_codec import encode
from tagloom.llm.toxicity import score_toxicity, train

#: Documents of this toxicity or more go.
REJECT = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops toxic documents; the machine learns from all labels, as found in the stage's own rows."""
    machine = train(docs, table(spark, sf_dir, "labels"))
    name = own_columns(docs, "toxicity")["toxicity"]
    return score_toxicity(docs, machine).where(F.col(name) < REJECT).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines; n_chars follows the text."""
    cut = dedup_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: that of the smallest id.."""
    found = jaccard_components(docs.select("doc_id", "text"))
    gone = found.where("component_id != doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    name = own_columns(docs, "contamination")["contamination"]
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where(~F.col(f"{name}.contaminated")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of what is kept."""
    return encode(docs.select("doc_id", "text")).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Stages 1 to 3 and 5 (training, shingle components, lattices) can't be said in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs)
    return docs
