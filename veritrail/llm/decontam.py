"""Benchmark decontamination by pigeonhole edit matching.

An item of n words may be met with at most k word edits (insertions, deletions,
replacements). It is split into k + 1 pieces, so at least one piece stands in the text
unharmed; the first words of every piece are looked up in all texts by a rolling hash,
and around each hit the least edit distance of the whole item is found with Myers'
bit-parallel algorithm, on words, at any place of the text. Words are runs of letters
and digits, in lower case.

Items come to the tasks in blocks of bounded size (BLOCK_CHARS), one pass over the
documents a block; documents never move. A benchmark of ten blocks costs ten scans.

Defined results: items and texts that are null or without words meet nothing; an item of
fewer than PROBE words must stand unharmed; several places of an item in one text are
one row, that of the least distance, then of the earliest place; rows of one doc_id (or
item_id) count as one document (item); other columns are not read (clean() keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import NOT_ALNUM, grams, in_row, lower, row_of, slices, word_hashes, written

#: Words of a piece that are looked up, and the least length of a piece.
PROBE = 5
#: Edits allowed for each word of an item.
EDITS = 0.2
#: Characters of items that one block may hold; a longer item is a block of its own.
BLOCK_CHARS = 4 << 20

SCHEMA = "doc_id long, item_id long, distance int, item_words int, first_word int, last_word int"


def budget(words: int, edits: float = EDITS, probe: int = PROBE) -> int:
    """Edits allowed for an item of so many words: each of its budget + 1 pieces has probe words at least."""
    return max(0, min(int(words * edits), words // probe - 1))


def myers(pattern: list[int], text: list[int], most: int) -> tuple[int, int] | None:
    """The least edit distance of pattern to any part of text, and the (first) end of that part; None if over most."""
    n = len(pattern)
    if not n:
        return None
    peq: dict[int, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = full, 0, n, (n, 0)
    for j, w in enumerate(text, 1):
        eq = peq.get(w, 0)
        x = eq | down
        d = ((((x & up) + up) ^ up) | x) & full
        h_up, h_down = down | (full & ~(d | up)), up & d
        if h_up & top:
            score += 1
        elif h_down & top:
            score -= 1
        h_up, h_down = h_up << 1 & full, h_down << 1 & full
        up, down = h_down | (full & ~(x | h_up)), h_up & x
        if score < best[0]:
            best = (score, j)
    return best if best[0] <= most else None


class Items:
    """A block of items, ready to be looked up."""

    def __init__(self, ids: list[int], texts: list[str], edits: float, probe: int):
        words, rows = word_hashes(lower(pa.array(texts, pa.string())), NOT_ALNUM)
        self.ids, self.words = ids, [words[a:b].tolist() for a, b in zip(rows, rows[1:], strict=False)]
        self.most = [budget(len(w), edits, probe) for w in self.words]
        found: dict[int, list[tuple[int, int, int]]] = {}
        for item, (w, k) in enumerate(zip(self.words, self.most, strict=True)):
            length = min(probe, len(w))
            for i in range(k + 1 if length else 0):
                at = len(w) * i // (k + 1)
                found.setdefault(length, []).append((int(grams(np.array(w[at : at + length], np.uint64), length)[0]), item, at))
        self.probes = {}
        for length, rows_ in found.items():
            rows_.sort()
            self.probes[length] = (np.array([r[0] for r in rows_], np.uint64), np.array([r[1] for r in rows_]), np.array([r[2] for r in rows_]))


def _matched(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Items = items.value
        for batch in slices(batches):
            words, rows = word_hashes(lower(batch["text"]), NOT_ALNUM)
            doc_of, hits = row_of(rows), set()
            for length, (names, item, at) in block.probes.items():
                here = grams(words, length)
                lo = np.searchsorted(names, here, "left")
                met = np.flatnonzero((names[np.minimum(lo, len(names) - 1)] == here) & in_row(rows, length))
                many = np.searchsorted(names, here[met], "right") - lo[met]
                nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                probe = np.repeat(lo[met], many) + nth
                place = np.repeat(met, many)
                hits.update(zip(doc_of[place].tolist(), item[probe].tolist(), (place - at[probe]).tolist(), strict=True))
            out, last = {}, (None, None, 0)
            for doc, item, start in sorted(hits):
                k, n = block.most[item], len(block.words[item])
                a, b = max(int(rows[doc]), start - k), min(int(rows[doc + 1]), start + n + k)
                if last[:2] == (doc, item) and a <= last[2] and b <= last[2]:
                    continue  # within what has been looked at
                last = (doc, item, max(b, last[2] if last[:2] == (doc, item) else b))
                found = myers(block.words[item], words[a:b].tolist(), k)
                if found:
                    back = myers(block.words[item][::-1], words[a : a + found[1]][::-1].tolist(), k)
                    end = a + found[1] - int(rows[doc])
                    row = (found[0], end - (back[1] if back else n), end - 1)
                    out[doc, item] = min(out.get((doc, item), row), row)
            docs = batch["doc_id"].to_pylist()
            done = [(docs[d], block.ids[i], r[0], len(block.words[i]), r[1], r[2]) for (d, i), r in sorted(out.items())]
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
            names = ["doc_id", "item_id", "distance", "item_words", "first_word", "last_word"]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in done], kind) for j, kind in enumerate(kinds)], names=names)

    return run


def matches(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, probe: int = PROBE) -> DataFrame:
    """One row per document and item it holds within the item's budget: distance and first and last word."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    found = None
    for block in range(blocks):
        part = items.where(f"pmod(xxhash64(item_id, text), {blocks}) = {block}").orderBy("item_id", "text").collect()
        held = spark.sparkContext.broadcast(Items([r[0] for r in part], [r[1] for r in part], edits, probe))
        here = texts.mapInArrow(_matched(held), SCHEMA)
        found = here if found is None else found.unionByName(here)
    best = F.min(F.struct("distance", "first_word", "last_word", "item_words")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.distance", "best.item_words", "best.first_word", "best.last_word")


def clean(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, probe: int = PROBE) -> DataFrame:
    """The rows of docs that hold no item, with their own columns; rows of null doc_id stay."""
    gone = written(matches(docs, benchmark, edits, probe).select(F.col("doc_id").alias("gone")).distinct(), "leaks")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")
