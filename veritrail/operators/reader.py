"""Readers answer questions from evidence. One interface, vectorized; models plug in as functions of two columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

Reader = Callable[[pd.Series, pd.Series], pd.DataFrame]
_WORD = re.compile(r"\w+")


def extractive(question: pd.Series, evidence: pd.Series) -> pd.DataFrame:
    """The sentence that shares most words with the question, the earliest of equals; deterministic."""
    answers, scores = [], []
    for q, e in zip(question.fillna(""), evidence.fillna(""), strict=True):
        asked = set(_WORD.findall(q.lower()))
        best, score = "", 0.0
        for s in re.split(r"(?<=[.!?])\s+", e):
            shared = len(asked.intersection(_WORD.findall(s.lower())))
            if shared > score:
                best, score = s.strip(), float(shared)
        answers.append(best or "unknown")
        scores.append(score / max(1, len(asked)))
    return pd.DataFrame({"answer": answers, "confidence": scores})


#: Characters of evidence that a reader gets at once, unless one row has more.
READ_CHARACTERS = 4 << 20


def read(df: DataFrame, reader: Reader = extractive, question: str = "question", evidence: str = "evidence") -> DataFrame:
    """df with answer and confidence; columns of those names are replaced.

    Only question and evidence become Python texts, READ_CHARACTERS of them at a time; other columns pass as they are.
    """
    df = df.drop("answer", "confidence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch[evidence]), 0).to_numpy(zero_copy_only=False).cumsum()
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(sizes.searchsorted((sizes[begin - 1] if begin else 0) + READ_CHARACTERS, side="right")))
                part = batch.slice(begin, end - begin)
                found = reader(part[question].to_pandas(), part[evidence].to_pandas())
                answers = [pa.array(found["answer"].tolist(), pa.string()), pa.array(found["confidence"].tolist(), pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *answers], names=[*part.schema.names, "answer", "confidence"])
                begin = end

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("answer", StringType()), StructField("confidence", DoubleType())]))


def iterative(questions: DataFrame, sentences: DataFrame, steps: int = 3, per_step: int = 5, reader: Reader = extractive) -> DataFrame:
    """Retrieve, read, and retrieve again with what was read: questions (qid, question) over sentences (qid, pos, sentence).

    Each step adds the unseen sentences with most words of the question and the last answer.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(\w+)")))
    state, seen = questions.select("qid", "question", F.lit("").alias("answer"), F.lit(0.0).alias("confidence")), None
    for _ in range(steps):
        fresh = sentences if seen is None else sentences.join(seen, ["qid", "pos"], "left_anti")
        asked = state.select("qid", words(F.concat_ws(" ", "question", "answer")).alias("asked"))
        scored = fresh.join(asked, "qid").withColumn("score", F.size(F.array_intersect("asked", words("sentence"))))
        top = scored.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "pos"))).where((F.col("r") == 1) | (F.col("score") > 0)).where(F.col("r") <= per_step)
        seen = top.select("qid", "pos") if seen is None else seen.unionByName(top.select("qid", "pos"))
        evidence = sentences.join(seen, ["qid", "pos"]).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("evidence"))
        state = read(questions.join(evidence, "qid", "left").select("qid", "question", "evidence"), reader).select("qid", "question", "answer", "confidence")
    return state
