"""Packing of tokenized documents into sequences by Karmarkar-Karp multiway differencing.

Documents are tokenized where they are read; no row moves. Each task fills blocks of
at most BLOCK_WINDOWS windows of tokens, so memory doesn't grow with the input: the
pieces of a block are partitioned into k windows by differencing (partial partitions
with opposing imbalances merge until one is left). The window count k rises by one for
each capacity that the block's tokens exceed, and never beyond: as documents may be cut
freely, what stands over the capacity of a window after differencing (a few hundredths)
is cut off and fills the room that others have, instead of opening another, nearly empty
window. All blocks of a task but its last are full, so at most one window a task is
padded.

Defined results: a null or empty text is one token (the end mark); repeated rows are
packed each for itself; a null doc_id stays null; an empty table gives no pieces; other
columns are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import slices

CAPACITY = 4096
BLOCK_WINDOWS = 64
PIECE = 1024
END_ID = 2
#: Distinct words and parts of words that a worker holds at most, about 250 bytes each.
CACHE_WORDS, CACHE_PARTS = 250_000, 500_000
#: Letters that normalization leaves as they are but for their case, then a stop or nothing.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(part.split()[0], pa.int64()) for part in SCHEMA.split(", ")])


def _byte_letters() -> dict[int, str]:
    """The alphabet of byte-level vocabularies: printable bytes stand for themselves, the others for code points from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of whole texts, found word by word.

    The tokenizer drops white space and never joins across it, so a text's ids are those
    of its words between spaces and line ends. It also parts letters from other characters
    and lowers them first, so a word of plain letters and a stop is the ids of both. Each
    distinct part is encoded once while it is held; words are forgotten after each task.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.end = np.array([end_id], "<u4").tobytes()
        # Lower-case letters need no normalization, so the model can be asked at once, if it is byte-level as expected.
        known = ("the", "straße", "élève", "x")
        self.direct = [self._model_ids(w) for w in known] == [self.tokenizer.encode(w, add_special_tokens=False).ids for w in known]

    def _model_ids(self, letters: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(letters.encode().decode("latin-1").translate(BYTE_LETTERS))]

    def _encode_letters(self, new: list[str]) -> None:
        if not self.direct:
            return self._encode_all(self.parts, new)
        tokenize = self.tokenizer.model.tokenize
        for letters in new:
            self.parts[letters] = array("I", [t.id for t in tokenize(letters.encode().decode("latin-1").translate(BYTE_LETTERS))]).tobytes()

    def _encode_all(self, known: dict[str, bytes], new: list[str]) -> None:
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for text, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[text] = array("I", found.ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, the end mark last."""
        split = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        for known, most in ((self.words, CACHE_WORDS), (self.parts, CACHE_PARTS)):
            if len(known) > most:
                known.clear()
        new = set().union(*split).difference(self.words)
        plain = {m[0]: (m[1].lower(), m[2]) for m in map(PLAIN.fullmatch, new) if m}
        self._encode_letters(list({a for a, _ in plain.values()}.difference(self.parts)))
        self._encode_all(self.parts, [x for x in ("", ".", ",") if x not in self.parts])
        self._encode_all(self.words, list(new.difference(plain)))
        parts = self.parts
        self.words.update((word, parts[a] + parts[b]) for word, (a, b) in plain.items())
        get = self.words.__getitem__
        return [b"".join(map(get, w)) + self.end for w in split]


@cache
def encoder(path: str) -> WordEncoder:
    """One for each Python worker, so that its parts are held over tasks."""
    return WordEncoder(path)


def differenced(sizes: list[int], k: int) -> np.ndarray:
    """The set, 0 to k - 1, of each size, so that sums are nearly equal, by the largest differencing method.

    A partial partition is its k falling sums and how it was merged; members are read off
    the merges from the last to the first.
    """
    heap, merges = [], []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = size
        heap.append((-size, i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, a_sums = heapq.heappop(heap)
        _, b, b_sums = heapq.heappop(heap)
        sums = a_sums + b_sums[::-1]  # the largest sum meets the smallest
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), len(sizes) + len(merges), sums))
        merges.append((a, b, order))
    where = {len(sizes) + len(merges) - 1: np.arange(k)}
    for at in range(len(merges) - 1, -1, -1):
        a, b, order = merges[at]
        found = where.pop(len(sizes) + at)
        of_a, of_b = np.empty_like(found), np.empty_like(found)
        of_a[order] = found
        of_b[k - 1 - order] = found
        where[a], where[b] = of_a, of_b
    return np.array([where[i][0] for i in range(len(sizes))], np.int64)


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Windows of (index, begin, length): parts of the sizes, each size whole or cut, none over capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(k)]
    room, over = [capacity] * k, []
    for i, w in enumerate(differenced(sizes, k).tolist()):
        kept = min(sizes[i], room[w])
        room[w] -= kept
        if kept:
            out[w].append((i, 0, kept))
        if kept < sizes[i]:
            over.append((i, kept, sizes[i] - kept))
    w = 0
    while over:
        i, begin, length = over.pop()
        while not room[w]:
            w += 1
        kept = min(length, room[w])
        room[w] -= kept
        out[w].append((i, begin, kept))
        if kept < length:
            over.append((i, begin + kept, length - kept))
    return out


def pieces(tokens: int, piece: int) -> Iterator[tuple[int, int]]:
    """Starts and lengths of a document's pieces: equal within one token, at most piece long."""
    n = -(-tokens // piece)
    cuts = [tokens * i // n for i in range(n + 1)]
    return ((a, b - a) for a, b in zip(cuts, cuts[1:], strict=False))


def _packer(path: str, capacity: int, piece: int, block: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, held, total = encoder(path).encode, [], 0
        next_id = TaskContext.get().partitionId() << 40

        def emptied() -> pa.RecordBatch:
            nonlocal held, total, next_id
            rows = []
            for window in windows([h[2] for h in held], capacity):
                offset = 0
                for i, begin, length in window:
                    doc, start, _, ids = held[i]
                    start += begin
                    rows.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, next_id, offset))
                    offset += length
                next_id += 1
            held, total = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=ARROW)

        for batch in slices(batches):
            for doc, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"].to_pylist()), strict=True):
                for start, length in pieces(len(ids) // 4, piece):
                    while total + length >= block * capacity:
                        part = block * capacity - total
                        held.append((doc, start, part, ids))
                        yield emptied()
                        start, length = start + part, length - part
                    if length:
                        held.append((doc, start, length, ids))
                        total += length
        if held:
            yield emptied()
        encoder(path).words.clear()

    return pack


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, piece: int = PIECE, block: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per piece: where it lies in its document, and in which sequence at what offset.

    docs needs doc_id and text. sequence_id is unique over the table: the task's number in
    its high bits, a count in the low ones; a task that runs again gives the same rows.
    """
    if not 0 < piece <= capacity:
        raise ValueError("piece must be from 1 to capacity")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_packer(path or tokenizer_path(), capacity, piece, block), SCHEMA)
