"""A corpus pipeline of five stages; each takes what the one before has kept.

Every stage returns the columns of documents; the last returns where each piece of
each document is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm import decontam, lines, neardup, packing, quality
from veritrail.llm.common import dropped, table, temporary, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns as op7_quality does."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.trained(texts, table(spark, sf_dir, "labels"), ~quality.held_out(F.col("doc_id")))
    return quality.keep_good(docs.select(*COLUMNS), weights)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that earlier documents hold; a document of which nothing is left goes."""
    found = lines.without_common_lines(docs.select(*COLUMNS))
    left = found.where("n_removed = 0 OR length(trim(BOTH ' \\t\\n\\r' FROM text)) > 0")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("rest.n_chars")).cast(docs.schema["n_chars"].dataType)
    return left.select("rest.doc_id", "text", "rest.lang", "rest.source", n_chars.alias("n_chars"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return neardup.deduplicated(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and the sequences they lie in."""
    return packing.packed(docs)


STAGES = [("quality classifier", classify), ("line dedup", dedup_lines), ("MinHash near-dedup", dedup_near), ("benchmark decontamination", decontaminate), ("packing", pack)]
#: Hash signatures, alignment, learned weights and a tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what all stages keep. Tables of a stage go once the next one is written; the last is read by the result."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with temporary(spark) as keep:
            docs = keep(written(stage(spark, docs, sf_dir), f"stage-{k}"))
        if before is not None:
            dropped(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
