"""Quality classifier: hashed word n-grams, logistic regression by follow the regularised leader.

A text's features are its words, its word pairs, and words and pairs of their shapes
(letters as one sign, digits as another, runs once), all hashed into one table of
weights; values are square roots of counts, of length one within words and within
shapes. Training is FTRL-proximal with per-coordinate rates, one row after the other,
in one executor task over a bounded sample of labelled rows: at most SAMPLE, of at most
SAMPLE doc_ids that a hash draws. Scores are sparse dot products, computed where
documents are read.

Defined results: a null or empty text has no features and scores by the bias alone;
repeated rows are scored each for itself; an empty table gives no rows; rows whose label
is null are not learned from; with no labelled row every score is 0.5; of several labels
of one doc_id the greatest counts, and of several rows of one the least text by hash is
learned from; a null doc_id has no label and is not held out; columns besides those named
are kept by keep_good and never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from veritrail.llm.common import grams, hashes, in_row, mix, row_of, slices, spans, text_bytes

BITS = 18
#: At most so many labelled rows are learned from; the bound keeps training in one task.
SAMPLE = 12_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
THRESHOLD = 0.3

_SHAPE = np.array([97 if b >= 128 or chr(b).isalpha() else 48 if chr(b).isdigit() else b for b in range(256)], np.uint8)
_SAME = np.uint64(0x5AE5AE5AE5AE5AE5)


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's shape."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    kinds = _SHAPE[data[np.arange(lengths.sum()) + np.repeat(starts - before, lengths)]]
    kept = np.ones(len(kinds), bool)
    kept[1:] = kinds[1:] != kinds[:-1]
    kept[before] = True
    at = (np.cumsum(kept) - 1)[before]
    kinds = kinds[kept]
    return hashes(kinds, at, np.append(at[1:], len(kinds)))


def features(col: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a text column: row, index and value of each entry, sorted by row."""
    data, offsets = text_bytes(col)
    starts, ends, rows = spans(data, offsets)
    words = hashes(data, starts, ends)
    found = []
    for family, signs in enumerate((words, _shapes(data, starts, ends))):
        pair = in_row(rows, 2)
        pairs = grams(signs, 2)[: len(pair)]
        if not family and len(pair):
            pairs = np.where(words[1:] == words[:-1], _SAME, pairs)
        row = row_of(rows)
        keys = np.concatenate([signs, pairs[pair]]) + np.uint64(family * 977)
        row = np.concatenate([row, row[: len(pair)][pair]])
        index = (mix(keys) >> np.uint64(64 - bits)).astype(np.int64)
        cells, counts = np.unique(row << bits | index, return_counts=True)
        row, index = cells >> bits, cells & ((1 << bits) - 1)
        square = np.bincount(row, counts, len(rows) - 1)
        found.append((row, index, np.sqrt(counts / np.maximum(square[row], 1))))
    row, index, value = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(row, kind="stable")
    return row[order], index[order], value[order]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        row, index, value = features(batch["text"])
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
        index, value = index.astype("<i4"), value.astype("<f4")
        cut = [(index[a:b].tobytes(), value[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"].cast(pa.int32()), pa.array([c[0] for c in cut], pa.binary()), pa.array([c[1] for c in cut], pa.binary())], names=["doc_id", "label", "index", "value"])


class Ftrl:
    """Logistic regression whose weights follow from sums of gradients, per coordinate."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last is the bias
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        index, value = np.append(index, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(index)
        gradient = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        n = self.n[index]
        self.z[index] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + gradient**2


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r["doc_id"], r["label"], r["index"], r["value"]) for b in batches for r in b.to_pylist())
    model = Ftrl()
    for epoch in range(EPOCHS):
        for at in np.random.Generator(np.random.PCG64(epoch)).permutation(len(rows)):
            _, label, index, value = rows[at]
            # A hashed word and a hashed shape may share a coordinate: they are two steps of it.
            cells, where = np.unique(np.frombuffer(index, "<i4"), return_inverse=True)
            model.learn(cells, np.bincount(where, np.frombuffer(value, "<f4"), len(cells)), label)
    yield pa.RecordBatch.from_arrays([pa.array([model.weights(slice(None)).astype("<f4").tobytes()], pa.binary())], names=["weights"])


def trained(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE, label: str = "quality") -> np.ndarray:
    """Weights learned from at most sample labelled rows that are usable (a condition on doc_id).

    The drawn ids are few (sample rows of two numbers), so they are broadcast and texts stay where they are.
    """
    drawn = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & usable)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    # One text of each doc_id, however many rows it has: partial aggregates keep one in each task.
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = rows.mapInArrow(_featured, "doc_id long, label int, index binary, value binary").repartition(1).mapInArrow(_trained, "weights binary").collect()
    return np.frombuffer(found[0][0], "<f4") if found else np.zeros((1 << BITS) + 1, "<f4")


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """All columns of docs, and score: the chance of label 1. A column named score is replaced."""
    docs = docs.drop("score")
    held = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, "<f4"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in slices(batches):
            row, index, value = features(batch["text"])
            margin = np.bincount(row, w[index] * value, batch.num_rows) + w[-1]
            found = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns alone."""
    # Other columns ride along under one name, so that none clashes and no join is needed.
    columns = docs.columns
    packed = docs.select("text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns if c != "text"]).alias("rest"))
    return scored(packed, weights).where(F.col("score") >= threshold).select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in columns])
