"""The queries of this subpackage, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm import decontam, licenses, lines, neardup, packing, private, quality, repeats, rules, shards
from veritrail.llm.common import shared_dir, table


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per doc_id: its class of near copies, and the least doc_id of the same words.

    Null and empty texts are one class; texts of one doc_id are linked; a null doc_id is left out; no documents, no rows.
    """
    return neardup.classes(table(spark, sf_dir, "documents"))


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its counts, whether the base rules fail it, and the verdict of the risk-controlled rules.

    A null or empty text has no words and fails the base; a stratum (lang, null included) without enough labels loses
    nothing to the rules; repeated rows are judged each for itself; no documents, no rows.
    """
    return rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its lines, how many go because an earlier document holds them, and a hash of what is left.

    A null text has no lines; rows of one doc_id are not aligned with each other and each loses its own lines; rows of a
    null doc_id lose none; no documents, no rows.
    """
    return lines.digest(table(spark, sf_dir, "documents"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, appended with all as small shards and compacted: where it lies in the last version, and a checksum of its text.

    Null texts count as empty in the checksum; repeated rows and null doc_ids are kept as they are; no documents, no rows.
    """
    store = shards.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.append(table(spark, sf_dir, "documents"), splits=shards.FANOUT)
    version = store.compact()
    store.expire()
    rows = store.read()
    if rows is None:
        rows = table(spark, sf_dir, "documents").where("false")
    rows = rows.select("doc_id", F.col("_metadata.file_path").alias("path"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    found = rows.join(store.manifest(), "path")
    shard = F.element_at(F.split("path", "/"), -1)
    return found.select("doc_id", "text_crc32", shard.alias("shard"), "tier", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), F.lit(version).alias("version"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece: where it lies in its document, and in which sequence at what offset.

    A null or empty text is the end mark alone; repeated rows and rows of a null doc_id are packed each for itself; no
    documents, no rows.
    """
    return packing.packed(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per place of a license notice: which, how much of it is there, and its words.

    Null and empty texts hold nothing; rows of one doc_id are scanned each for itself, a null doc_id stays null; no
    documents or no notices, no rows.
    """
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: whether it is held out, its score and the prediction.

    A null or empty text scores by the bias alone; repeated rows are scored each for itself; a null doc_id is scored, not
    held out and never learned from; without labels all scores are 0.5; no documents, no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.trained(docs, table(spark, sf_dir, "labels"), ~quality.held_out(F.col("doc_id")))
    found = quality.scored(docs, weights).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score")
    return found.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its words, how many go because a window of 35 stands elsewhere too, and a hash of the rest.

    A null or empty text has no words; rows of a null or repeated doc_id are documents of their own; windows that overlap
    their own copy count; no documents, no rows.
    """
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


def op9_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: base spans by kind, their hash, all spans, and how many there are.

    A null or empty text has no spans; repeated rows are read each for itself, a null doc_id stays null; no documents, no
    rows.
    """
    return private.digest(table(spark, sf_dir, "documents"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item it holds within the item's budget of edits.

    Texts and items that are null or without words meet nothing; several places of an item in one document, and rows of
    one doc_id, are one row; no documents or no items, no rows.
    """
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_neardup, op2_rules, op3_lines, op4_shards, op5_packing, op6_licenses, op7_quality, op8_repeats, op9_private, op10_decontam)
}
SQL: dict[str, str] = {"op2_rules": rules.SQL}
