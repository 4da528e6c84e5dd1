"""Substring dedup by recompression: long repeats are found through symbols that name what they hold.

Each text's words are symbols of level 0. A round of recompression first makes each run
of equal symbols one symbol, named by the symbol and its count, and then each pair of a
left and a right symbol one (a bit of a name tells its side), named by both. A name is a
64-bit hash of what it names, so every task names runs and pairs as all others do,
without a dictionary to share, and equal substrings have equal symbols inside. With each
symbol goes its context: the words that decided that it begins, ends and is named so.
Wherever these words stand, they make that symbol at the same place.

Of the symbols whose context lies within a window, that of the highest level (then the
least name, then the first) is the window's anchor, and a window that stands elsewhere
has the same anchor there. A window in which no symbol is decided, as within a long run,
is its own anchor. Spark then works in rounds on anchors alone. First, names of anchors
(with their context) are counted over all texts, and those that stand once are dropped.
The windows of one anchor are a stretch of words; in the second round, stretches of one
name are compared by a 128-bit cryptographic digest of all their words: one that stands
twice as a whole has all its windows repeated, which settles the inside of every copy
with one row an anchor. Only where stretches of one name differ, at the ends of copies,
a third round compares single windows, one holder of each stretch standing for all (by
64 bits besides the 64 of the name).

Defined results: a null or empty text has no words; texts shorter than a window lose
nothing; a window that stands twice in one text counts as repeated, overlaps included;
rows of a null or repeated doc_id are documents of their own: anchors and stretches belong
to a hash of 64 bits of doc_id and text, and equal texts lose the same words; an empty
table gives no rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import dropped, grams, hashes, in_row, mix, ranges, row_of, slices, spans, text_bytes, written

WINDOW = 35
ROUNDS = 3
#: Windows of one stretch at most, so that their marks fit into a number.
STRETCH = 60
#: Where a context that reaches beyond its text begins or ends.
_OUT = 1 << 40


class Symbols(NamedTuple):
    """Symbols in their order: names, the words they hold (start to end), those that decide them (low to high), and their rows."""

    names: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    row: np.ndarray


def _shifted(values: np.ndarray, row: np.ndarray, by: int, else_: int) -> np.ndarray:
    """For each symbol, the value of the one before (by = 1) or after it (by = -1) in its row."""
    out = np.full(len(values), else_, np.int64)
    if by > 0:
        same = row[1:] == row[:-1]
        out[1:][same] = values[:-1][same]
    else:
        same = row[1:] == row[:-1]
        out[:-1][same] = values[1:][same]
    return out


def runs(s: Symbols, level: int) -> Symbols:
    """Each run of equal symbols becomes one; that a run ends where it does is decided by the symbols beside it."""
    first = np.ones(len(s.names), bool)
    first[1:] = (s.names[1:] != s.names[:-1]) | (s.row[1:] != s.row[:-1])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(first)) - 1
    count = last - at + 1
    names = np.where(count > 1, mix(s.names[at] * np.uint64(0x9E3779B97F4A7C15) + mix(count.astype(np.uint64) + np.uint64(level * 0x10001))), s.names[at])
    low = _shifted(s.low, s.row, 1, -_OUT)[at]
    high = _shifted(s.high, s.row, -1, _OUT)[last]
    return Symbols(names, s.start[at], s.end[last], low, high, s.row[at])


def pairs(s: Symbols, level: int) -> Symbols:
    """Each left symbol and the right one after it become one; what stays is decided by the symbol it could have met."""
    right = (mix(s.names + np.uint64(level + 1)) >> np.uint64(63)).astype(bool)
    second = np.zeros(len(s.names), bool)
    second[1:] = ~right[:-1] & right[1:] & (s.row[1:] == s.row[:-1])
    merged = np.append(second[1:], False)
    after = np.append(s.names[1:], np.uint64(0))
    names = np.where(merged, mix(mix(s.names + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15) + after), s.names)
    low = np.where(right, np.minimum(s.low, _shifted(s.low, s.row, 1, -_OUT)), s.low)
    high = np.where(right, s.high, np.maximum(s.high, _shifted(s.high, s.row, -1, _OUT)))
    end = np.where(merged, np.append(s.end[1:], 0), s.end)
    kept = ~second
    return Symbols(names[kept], s.start[kept], end[kept], low[kept], high[kept], s.row[kept])


def recompressed(words: np.ndarray, rows: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    """The symbols after each round."""
    at = np.arange(len(words))
    s, out = Symbols(words, at, at + 1, at, at + 1, row_of(rows)), []
    for level in range(1, rounds + 1):
        s = pairs(runs(s, level), level)
        out.append(s)
    return out


def _chosen(ranks: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each number in at, the first of the least ranks of those with lo <= number <= hi (both rising), or -1."""
    a, b = np.searchsorted(hi, at, "left"), np.searchsorted(lo, at, "right")
    many = np.maximum(b - a, 0)
    out = np.full(len(at), -1, np.int64)
    width, best = 1, np.arange(len(ranks))
    while len(at) and width <= many.max():
        here = np.flatnonzero((many >= width) & (many < 2 * width))
        x, y = best[a[here]], best[b[here] - width]
        out[here] = np.where(ranks[x] <= ranks[y], x, y)
        x, y = best[: max(0, len(best) - width)], best[width:]
        best = np.where(ranks[x] <= ranks[y], x, y)
        width *= 2
    return out


class Stretches(NamedTuple):
    """Stretches in their order: first window and number of windows, name, and where the anchor lies from the first window on."""

    lo: np.ndarray
    count: np.ndarray
    name: np.ndarray
    offset: np.ndarray


def stretched(words: np.ndarray, rows: np.ndarray, window: int = WINDOW) -> Stretches:
    """All windows of the rows, those of one anchor together."""
    at = np.flatnonzero(in_row(rows, window))
    which, start = -1 - at, at.copy()  # a window is its own anchor, unless a symbol is found
    name = grams(words, window)[at] if len(at) else np.zeros(0, np.uint64)
    left, base = np.arange(len(at)), 0
    for level, s in reversed(list(enumerate(recompressed(words, rows), 1))):
        inside = np.flatnonzero((s.low >= 0) & (s.high <= len(words)) & (s.high - s.low <= window))
        lo, hi = s.high[inside] - window, s.low[inside]
        found = _chosen(mix(s.names[inside]), lo, hi, at[left])
        some = np.flatnonzero(found >= 0)
        symbol = inside[found[some]]
        which[left[some]], start[left[some]] = base + symbol, s.start[symbol]
        # A name in its context: the symbol, the words that decide it, and where it begins among them.
        context = mix(s.names[symbol] + np.uint64(level)) + (s.start[symbol] - s.low[symbol]).astype(np.uint64)
        name[left[some]] = mix(ranges(words, s.low[symbol], s.high[symbol]) ^ mix(context)) if len(some) else name[left[some]]
        left, base = left[found < 0], base + len(s.names)
    part = (start - at) // STRETCH
    first = np.ones(len(at), bool)
    first[1:] = (which[1:] != which[:-1]) | (part[1:] != part[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(first)
    return Stretches(at[begin], np.diff(np.append(begin, len(at))), mix(name[begin] + part[begin].astype(np.uint64)), start[begin] - at[begin])


def _hashed(batch: pa.RecordBatch):
    data, offsets = text_bytes(batch["text"])
    starts, ends, rows = spans(data, offsets)
    return data, starts, ends, rows, hashes(data, starts, ends)


def _anchored(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            *_, rows, words = _hashed(batch)
            found = stretched(words, rows, window)
            row = row_of(rows)[found.lo]
            doc = batch["doc"].to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(found.name.view(np.int64)), pa.array(doc[row]), pa.array((found.lo - rows[row]).astype(np.int32))], names=["name", "doc", "lo"])

    return run


def _compared(window: int):
    """Stretches whose anchor's name stands elsewhere too: a digest of all their words, and a hash of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, starts, ends, rows, words = _hashed(batch)
            found = stretched(words, rows, window)
            known = np.zeros(len(words), bool)
            for k, some in enumerate(batch["known"]):
                known[some.values.to_numpy() + rows[k]] = True
            lo, count, name, offset = (x[known[found.lo]] for x in found)
            digests = bytearray()
            for a, b, n, o in zip(starts[lo].tolist(), ends[lo + count + window - 2].tolist() if len(lo) else [], count.tolist(), offset.tolist(), strict=True):
                digests += hashlib.blake2b(b"%d %d " % (n, o) + b" ".join(data[a:b].tobytes().split()), digest_size=16).digest()
            digest = np.frombuffer(bytes(digests), "<i8").reshape(-1, 2)
            cuts = np.concatenate([[0], np.cumsum(count)])
            at = np.arange(cuts[-1]) - np.repeat(cuts[:-1], count) + np.repeat(lo, count)
            hashed = grams(words, window)[at] if len(at) else np.zeros(0, np.uint64)
            row = row_of(rows)[lo]
            doc = batch["doc"].to_numpy(zero_copy_only=False)
            windows = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(hashed.view(np.int64)))
            columns = [pa.array(name.view(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(doc[row]), pa.array((lo - rows[row]).astype(np.int32)), windows]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "d1", "d2", "doc", "lo", "windows"])

    return run


def _cut(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_bytes(batch["text"])
            starts, ends, rows = spans(data, offsets)
            out = []
            for k, found in enumerate(batch["repeated"].to_pylist()):
                a, b = rows[k], rows[k + 1]
                gone = np.zeros(b - a + 1, np.int64)
                if found:
                    p = np.array([f["lo"] + i for f in found for i in range(f["k"]) if f["mask"] >> i & 1], np.int64)
                    np.add.at(gone, p, 1)
                    np.add.at(gone, p + window, -1)
                kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0) + a
                text = b" ".join(data[starts[i] : ends[i]].tobytes() for i in kept) if found else b" ".join(data[offsets[k] : offsets[k + 1]].tobytes().split())
                out.append((int(b - a), int(b - a - len(kept)), hashlib.sha256(text).hexdigest(), text.decode() if with_text else None))
            columns = [pa.array([o[j] for o in out], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def _repeated(df: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key stands at least twice, and the table of such keys, to be dropped after use.

    Counts are partial first; they are written, so that the join deals out both of its sides by itself and splits a hot key.
    """
    keys = written(df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated-keys")
    return df.join(keys, key), keys


def without_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text of every document.

    docs needs doc_id and text. A window is window consecutive words of one text; each word
    covered by a window that also starts anywhere else is removed.
    """
    if window < 1:
        raise ValueError("a window has one word at least")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("doc", F.xxhash64("doc_id", "text"))
    # Written, so that no text is recompressed twice for it: once for the counts, once for the join.
    anchored = written(docs.mapInArrow(_anchored(window), "name long, doc long, lo int"), "anchored")
    found, names = _repeated(anchored, ["name"])
    found = written(found.select("doc", "lo"), "anchors")
    dropped(docs.sparkSession, anchored, names)
    # A set: of a row that stands many times, the places are listed once.
    per_doc = found.groupBy("doc").agg(F.collect_set("lo").alias("known"))
    held = written(docs.join(per_doc, "doc").mapInArrow(_compared(window), "name long, d1 long, d2 long, doc long, lo int, windows array<long>"), "stretches")
    kind = ["name", "d1", "d2"]
    kinds = written(held.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct("doc", "lo")).alias("holder")), "stretch-kinds")
    # Names of which a stretch stands once and others beside it: their windows are compared singly.
    mixed = kinds.groupBy("name").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1").select("name")
    mixed = written(mixed, "mixed-names")
    holders = kinds.join(mixed, "name").select(*kind, "holder.doc", "holder.lo")
    # A row that stands many times holds its stretches as often; one of them is enough.
    single = held.join(holders, [*kind, "doc", "lo"]).groupBy(*kind).agg(F.first("windows").alias("windows")).select(*kind, F.posexplode("windows").alias("i", "window"))
    single = written(single, "single-windows")
    again, twice = _repeated(single, ["name", "window"])
    again = again.groupBy(*kind).agg(F.expr("bit_or(shiftleft(1L, i))").alias("mask"))
    masks = kinds.join(again, kind, "left").selectExpr(*kind, "CASE WHEN n > 1 THEN -1L ELSE mask END AS mask").where("mask IS NOT NULL")
    masks = written(masks, "masks")
    rows = held.selectExpr(*kind, "doc", "lo", "size(windows) AS k").join(masks, kind)
    starts = written(rows.groupBy("doc").agg(F.collect_set(F.struct("lo", "k", "mask")).alias("repeated")), "repeats")
    dropped(docs.sparkSession, found, twice, held, kinds, mixed, single, masks)
    out = docs.join(starts, "doc", "left").mapInArrow(_cut(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if with_text else out.drop("kept_text")
