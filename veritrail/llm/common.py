"""Shared pieces: tables in the shared folder, and word hashing over Arrow buffers.

Words are maximal runs of bytes outside the six ASCII white-space characters
(9 to 13 and 32), so `[^\\x20\\x09-\\x0D]+`. A whole Arrow batch is hashed with
numpy at once; batches are cut to a few MB of text so that memory stays bounded.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 2 << 20
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_KEYS = _RNG.integers(1, 2**63, size=4096, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Every ASCII character but letters and digits separates; bytes of longer characters never do.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; where none is named, a folder of our own on a single machine, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"{tempfile.gettempdir()}/veritrail-shared"
    return found.rstrip("/")


#: Spark drops a query's shuffle files as soon as its result stands.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage ends here.

    A lost executor then costs the tasks that read the table, not those that made it.
    Shuffle files of what has been written are let go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    if (scope := _SCOPE.get()) is not None:
        scope.append(out)
    return out


#: Tables written within temporary(), if we are in it.
_SCOPE: ContextVar[list[DataFrame] | None] = ContextVar("tables", default=None)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete at the end all tables of written() that are made within, but for those given to the function that it yields."""
    tables, kept = [], []
    outer, token = _SCOPE.get(), _SCOPE.set(tables)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        paths = {t.written_path for t in kept}
        dropped(spark, *(t for t in tables if t.written_path not in paths))
        if outer is not None:
            outer.extend(kept)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of written() that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def lower(col: pa.Array) -> pa.Array:
    """Texts in lower case; null is empty."""
    return pc.utf8_lower(pc.fill_null(col.cast(pa.large_string()), ""))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the n + 1 offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of about limit bytes of text; a longer text comes alone. At the end, free memory goes back to the system."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    returned()


def returned() -> None:
    """Give free memory back: workers outlive their tasks, and what they hold counts for the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (bytes), and for each row the index of its first word (n + 1 values)."""
    inside = ~apart[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        first[cuts] |= inside[cuts]
        last[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span: multilinear over bytes, then mixed. Long inputs are taken in parts."""
    lengths = ends - starts
    total = np.cumsum(lengths)
    cuts = np.searchsorted(total, np.arange(SLICE_BYTES, total[-1] if len(total) else 0, SLICE_BYTES), "right")
    parts = np.unique(np.concatenate([[0], cuts, [len(starts)]]))
    found = [_hashed_part(data, starts[a:b], lengths[a:b]) for a, b in zip(parts, parts[1:], strict=False)]
    return np.concatenate([np.zeros(0, np.uint64), *found])


def _hashed_part(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    at = np.cumsum(lengths) - lengths
    rel = np.arange(lengths.sum()) - np.repeat(at, lengths)
    value = data[rel + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    if (far := rel >= len(_BYTE_KEYS)).any():
        keys = np.where(far, mix(rel.astype(np.uint64)) | np.uint64(1), _BYTE_KEYS[np.minimum(rel, len(_BYTE_KEYS) - 1)])
    else:
        keys = _BYTE_KEYS[rel]
    return mix(np.add.reduceat(value * keys, at) + lengths.astype(np.uint64))


def word_hashes(col: pa.Array, apart: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column, and the n + 1 offsets of its rows among them."""
    data, offsets = text_bytes(col)
    starts, ends, rows = spans(data, offsets, apart)
    return hashes(data, starts, ends), rows


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (shorter array by k - 1; rows are not regarded)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 8:
        total = words[:n].copy()
        for j in range(1, k):
            total *= BASE
            total += words[j : j + n]
        return mix(total)
    return ranges(words, np.arange(n), np.arange(k, k + n))


def ranges(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words of each range, which depends on nothing else."""
    powers = np.full(len(words) + 1, BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers[:-1], out=sums[1:])
    back = np.full(len(words) + 1, BASE_INV, np.uint64)
    back[0] = 1
    return mix((sums[end] - sums[first]) * np.cumprod(back)[first])


def in_row(rows: np.ndarray, k: int) -> np.ndarray:
    """For each position from which k words start: whether they lie in one row."""
    n = int(rows[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    lengths = np.diff(rows)
    end = np.repeat(rows[1:], lengths)[:n]
    return ok & (np.arange(n) + k <= end)


def row_of(rows: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))
