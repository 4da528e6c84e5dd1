"""Line dedup by pairwise alignment of documents that share rare lines.

Documents are lists of line hashes (a line is its words, so white space doesn't count).
Each line of at least MIN_WORDS words counts as rare, however many documents hold it; a
shorter line counts through its keys, the stretches from it to the nearest line of
MIN_WORDS words on either side. A document is aligned with earlier holders of its keys by
patience diff: lines that stand once in both, put into a longest increasing sequence, then
the gaps between them, and what is equal at the ends of each. Runs of aligned lines with
a line of MIN_WORDS words among them are deleted from the later document; what is deleted
is what an alignment with any earlier holder deletes.

A document first meets the first holder of each key, which settles nearly all of them. For
keys of lines that still stand, it meets further holders in growing rounds until the lines
are deleted or no holder is left. Holders that read the same, but for lines of no other
document, align the same with all: they are one profile, met once. So pairs grow with
lines and with the distinct profiles of what stays open, not with the square of a group.

Defined results: a null text has no lines and stays null; a text that is deleted whole
becomes empty; lines are parted by \\n alone; lines that repeat within one document stay;
documents are ordered by doc_id, and rows of one doc_id are not aligned with each other:
each loses its own lines (rows are told apart by a hash of their text); rows of a null
doc_id stay as they are; an empty table gives no rows; other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from veritrail.llm.common import hashes, mix, ranges, row_of, slices, spans, temporary, text_bytes, written

MIN_WORDS = 5
#: Profiles of a key that the first further round meets, the growth of later rounds, and their largest step.
STEP, GROWTH, MOST = 4, 8, 2048
#: Stands for lines of no other document; hashes of lines are odd or 0.
ALONE = 2


def line_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of a column: a hash of its words (0: no words), its number of words, and rows' offsets among lines."""
    data, offsets = text_bytes(col)
    breaks = np.flatnonzero(data == 10)
    filled = np.flatnonzero(np.diff(offsets))
    begins = np.sort(np.concatenate([offsets[:-1][filled], breaks + 1]))
    # A break at the end of a row begins an empty line there, beside the next row's first line.
    owner = np.searchsorted(offsets, begins, "right") - 1
    ended = np.isin(breaks + 1, offsets[1:])
    if ended.any():
        own = np.searchsorted(offsets, breaks, "right") - 1
        begins = np.concatenate([offsets[:-1][filled], breaks + 1])
        owner = np.concatenate([filled, own])
        order = np.lexsort((begins, owner))
        begins, owner = begins[order], owner[order]
    rows = np.searchsorted(owner, np.arange(len(offsets)))
    starts, ends, _ = spans(data, offsets)
    words = hashes(data, starts, ends)
    line = np.searchsorted(begins, starts, "right") - 1
    # An empty last line begins where the next row does: the word belongs to the latter, which sorts last.
    sizes = np.bincount(line, minlength=len(begins))[: len(begins)]
    at = np.cumsum(sizes) - sizes
    place = np.arange(len(words), dtype=np.uint64) - np.repeat(at, sizes).astype(np.uint64)
    total = np.zeros(len(begins), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        total[some] = mix(np.add.reduceat(mix(words + mix(place + np.uint64(5))), at[some]) + sizes[some].astype(np.uint64)) | np.uint64(1)
    return total, sizes, rows


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of equal lines of a and b, rising in both, by patience diff."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i == i2 or j == j2:
            continue
        once = {x for x, n in Counter(a[i:i2]).items() if n == 1} & {x for x, n in Counter(b[j:j2]).items() if n == 1}
        if not once:
            continue
        where = {x: k for k, x in enumerate(b[j:j2], j) if x in once}
        tops: list[int] = []  # patience piles: the least last partner of each length
        piles, back = [], {}
        for k in range(i, i2):
            if a[k] in once:
                y = where[a[k]]
                p = bisect_left(tops, y)
                back[k] = piles[p - 1] if p else None
                if p == len(tops):
                    tops.append(y)
                    piles.append(k)
                else:
                    tops[p], piles[p] = y, k
        k, chain = piles[-1], []
        while k is not None:
            chain.append((k, where[a[k]]))
            k = back[k]
        lo_i, lo_j = i, j
        for x, y in reversed(chain):
            out.append((x, y))
            todo.append((lo_i, x, lo_j, y))
            lo_i, lo_j = x + 1, y + 1
        todo.append((lo_i, i2, lo_j, j2))
    return sorted(out)


def common_lines(first: list[int], later: list[int], rare: list[bool]) -> set[int]:
    """Indexes of later's lines in aligned blocks that hold a line for which rare is true."""
    gone, block = set(), []
    for pair in [*aligned(first, later), (-9, -9)]:
        if block and pair != (block[-1][0] + 1, block[-1][1] + 1):
            if any(rare[j] for _, j in block):
                gone.update(j for _, j in block)
            block = []
        block.append(pair)
    return gone


def line_keys(lines: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of lines, the index of each key's line in its row, and rows' offsets among keys.

    The key of a line of MIN_WORDS words is its hash; a shorter line has a key for the nearest such line on either
    side, the hash of all from the one to the other: a block that deletes it must hold one of the two stretches.
    """
    at, row = np.arange(len(lines)), row_of(rows)
    long = sizes >= MIN_WORDS
    before = np.maximum.accumulate(np.where(long, at, -1))
    after = np.minimum.accumulate(np.where(long, at, len(lines))[::-1])[::-1]
    left = np.flatnonzero(~long & (before >= rows[row]))
    right = np.flatnonzero(~long & (after < rows[row + 1]))
    place = np.concatenate([at[long], left, right])
    keys = np.concatenate([lines[long], ranges(lines, before[left], left + 1), ranges(lines, right, after[right] + 1)])
    order = np.argsort(place, kind="stable")
    place = place[order]
    return keys[order], place - rows[row[place]], np.searchsorted(place, rows)


def _lined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        total, sizes, rows = line_hashes(batch["text"])
        keys, places, cuts = line_keys(total, sizes, rows)
        offsets, cuts = pa.array(rows.astype(np.int32)), pa.array(cuts.astype(np.int32))
        found = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (total.view(np.int64), sizes.astype(np.int32))]
        found += [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (keys.view(np.int64), places.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([batch["doc"], batch["row"], *found], names=["doc", "row", "lines", "sizes", "keys", "places"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows as Python objects, a few hundred at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256).to_pylist()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair of a document and what an earlier one holds (other): the document's lines that go."""
    for rows in _rows(batches):
        found = ((r["doc"], r["row"], sorted(common_lines(r["other"], r["lines"], [n >= MIN_WORDS for n in r["sizes"]]))) for r in rows)
        out = [x for x in found if x[2]]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], kind) for j, kind in enumerate(kinds)], names=["doc", "row", "gone"])


def _standing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All deleted lines of each document (gone and more), and the keys of lines that still stand, of those in open if it is given."""
    for rows in _rows(batches):
        out = []
        for r in rows:
            gone = {*(r["gone"] or ()), *(r["more"] or ())}
            still = {k for k, p in zip(r["keys"], r["places"], strict=True) if p not in gone}
            out.append((r["doc"], r["row"], sorted(gone), sorted(still if r["open"] is None else still.intersection(r["open"]))))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], kind) for j, kind in enumerate(kinds)], names=["doc", "row", "gone", "open"])


def _more(pairs: DataFrame) -> DataFrame:
    """doc, row and more: what goes from a document by all its pairs; no list is longer than its lines."""
    found = pairs.select("doc", "row", "lines", "sizes", "other").mapInArrow(_blocks, "doc long, row long, gone array<int>")
    return found.select("doc", "row", F.explode("gone").alias("at")).groupBy("doc", "row").agg(F.collect_set("at").alias("more"))


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents' lines, where runs of long lines that no other document holds are one ALONE."""
    for rows in _rows(batches):
        out = []
        for r in rows:
            shared, profile = set(r["shared"]), []
            for x, n in zip(r["lines"], r["sizes"], strict=True):
                x = ALONE if n >= MIN_WORDS and x not in shared else x
                if x != ALONE or profile[-1:] != [ALONE]:
                    profile.append(x)
            out.append(profile)
        yield pa.RecordBatch.from_arrays([pa.array([r["doc"] for r in rows], pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["doc", "profile"])


MET = "doc long, row long, gone array<int>, open array<long>"


def _further(lined: DataFrame, held: DataFrame, shared: DataFrame, first: DataFrame, met: DataFrame) -> DataFrame:
    """doc, row and gone of the documents in met whose lines still stand though an earlier document holds their keys."""
    keys = met.select("doc", "row", F.explode("open").alias("key")).join(shared.select("doc", "key").distinct(), ["doc", "key"])
    todo = written(keys.groupBy("doc", "row").agg(F.collect_set("key").alias("open")).join(met.select("doc", "row", "gone"), ["doc", "row"]).select("doc", "row", "gone", "open").dropDuplicates(["doc", "row"]), "open-lines")
    wanted = written(todo.select(F.explode("open").alias("key")).distinct(), "open-keys")
    holders = written(held.join(wanted, "key"), "open-holders")
    # The first holder, too, is a holder that shares its lines.
    of_doc = held.join(holders.select("doc").distinct(), "doc").join(first.select("key"), "key").groupBy("doc").agg(F.collect_list("key").alias("shared"))
    profiles = lined.join(of_doc, "doc").select("doc", "lines", "sizes", "shared").mapInArrow(_profiled, "doc long, profile array<long>")
    kinds = written(holders.join(profiles, "doc").groupBy("key", "profile").agg(F.min("doc").alias("least")), "profiles")
    counts = written(kinds.groupBy("key").agg(F.count("*").alias("n")), "profile-counts")
    # An order by hash: about as many profiles of a key lie below a number as it says, and no key is sorted in one task.
    kinds = written(kinds.join(counts, "key").selectExpr("key", "profile", "least", "n * (pmod(xxhash64(profile), 1048576L) / 1048576D) AS place"), "placed-profiles")
    last = counts.agg(F.max("n")).first()[0] or 0
    base = written(lined.join(todo.select("doc", "row"), ["doc", "row"]).dropDuplicates(["doc", "row"]), "open-documents")
    lo, step = 0, STEP
    while lo < last:
        near = kinds.where((F.col("place") >= lo) & (F.col("place") < lo + step))
        pairs = todo.select("doc", "row", F.explode("open").alias("key")).join(near, "key").where("least < doc").select("doc", "row", F.col("profile").alias("other")).distinct()
        more = _more(pairs.join(base, ["doc", "row"]))
        todo = written(base.join(todo, ["doc", "row"]).join(more, ["doc", "row"], "left").mapInArrow(_standing, MET), "open-lines")
        if todo.where("size(open) > 0").isEmpty():
            break
        lo, step = lo + step, min(step * GROWTH, MOST)
    return todo


def deleted_lines(docs: DataFrame) -> DataFrame:
    """doc, row (a hash of the text) and gone: the indexes of its lines that aligned blocks with earlier documents hold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("doc IS NOT NULL AND text IS NOT NULL").withColumn("row", F.xxhash64("text"))
    lined = written(rows.mapInArrow(_lined, "doc long, row long, lines array<long>, sizes array<int>, keys array<long>, places array<int>"), "lines")
    held = lined.selectExpr("doc", "explode(array_distinct(keys)) AS key")
    first = held.groupBy("key").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Written, so that the join below deals out both of its sides by itself and splits a hot line.
    first = written(first, "first-holders")
    shared = written(held.join(first, "key").where("first < doc").select("doc", "key", "first"), "shared-lines")
    pairs = written(shared.select("doc", "first").distinct(), "line-pairs")
    met = pairs.join(lined.selectExpr("doc AS first", "lines AS other"), "first").join(lined.select("doc", "row", "lines", "sizes"), "doc")
    more = written(_more(met), "aligned")
    met = lined.join(pairs.select("doc").hint("merge"), "doc", "left_semi").join(more, ["doc", "row"], "left").selectExpr("*", "cast(NULL AS array<int>) AS gone", "cast(NULL AS array<long>) AS open")
    met = written(met.mapInArrow(_standing, MET), "met")
    further = _further(lined, held, shared, first, met)
    out = met.select("doc", "row", "gone").unionByName(further.select("doc", "row", "gone")).groupBy("doc", "row").agg(F.max_by("gone", F.size("gone")).alias("gone"))
    return written(out.where("size(gone) > 0"), "deleted")


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts, counts, removed = [], [], []
        for text, gone in zip(batch["text"].to_pylist(), batch["gone"].to_pylist(), strict=True):
            lines = text.split("\n") if text else []
            cut = set(gone or ())
            texts.append("\n".join(x for k, x in enumerate(lines) if k not in cut) if cut else text)
            counts.append(len(lines))
            removed.append(len(cut))
        columns = [batch["rest"], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["rest", "text", "n_lines", "n_removed"])


def without_common_lines(docs: DataFrame) -> DataFrame:
    """rest (all columns of docs but text, as a struct), text without deleted lines, n_lines and n_removed."""
    with temporary(docs.sparkSession) as keep:
        gone = keep(deleted_lines(docs))
    columns = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("rest"), F.col("text").cast("string").alias("text"))
    # The hint keeps the plan the same at every size.
    rows = rows.withColumn("doc", F.col("rest.doc_id").cast("long")).withColumn("row", F.xxhash64("text")).join(gone.hint("merge"), ["doc", "row"], "left").select("rest", "text", "gone")
    rest = StructField("rest", rows.schema["rest"].dataType)
    kinds = StructType([rest, StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_removed", LongType())])
    return rows.mapInArrow(_shortened, kinds)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 (of the text that is left, null: empty)."""
    found = without_common_lines(docs.select("doc_id", "text"))
    return found.select("rest.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
