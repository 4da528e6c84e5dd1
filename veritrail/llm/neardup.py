"""MinHash near-dedup by BagMinHash: signatures of weighted sets, banding, multiset verification.

A text is the bag of its five-word shingles. Each shingle of weight w runs one Poisson
process for each dyadic interval of weights that w reaches ([0,1), [1,2), [2,4), ...);
a process's points carry a time, a component of the signature and a weight, and count
if that weight lies below w. Component i of the signature is the earliest point that
fell on it, so two texts agree on a component with the chance of their weighted Jaccard
similarity, whatever the weights. Points are made in rounds over a whole batch, and a
process ends once its time is past the latest component of its text. A bag so small that
only an equal bag is similar (fewer than four shingles) needs no processes: its
components are hashes of the whole bag.

Texts of the same words are one text from the start (class of copies). Texts that share
a bucket of equal bands are candidates. Each is first verified against the least text of
each of its buckets (the pivot), which joins nearly all of a group of copies with one
pair a text. Those that are then in another class than a pivot of theirs are outsiders
of that pivot's class: buckets are taken together by the class of their pivots, and there
an inverted index of shingles gives the exact overlap of each outsider with all texts.
So every two texts that share a bucket end in one class or are compared, and the path is
the same at every size: outsiders and texts of a class are dealt out in blocks of
BLOCK_WORDS shingles, each pair of blocks as one group. Links make classes in rounds:
tasks join what they hold, then numbers point on to what their label points to.

A pair of similarity 0.8 escapes all bands with a chance of (1 - 0.8 ** 5) ** 25, 5e-5.

Defined results: null or empty texts are equal texts without words and one class; texts
of fewer than five words have the one shingle of all their words; of equal doc_ids one
row is returned and their texts are linked; a null doc_id is left out; an empty table
gives no rows; other columns are not read (deduplicated() keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import dropped, grams, in_row, mix, row_of, slices, temporary, word_hashes, written

SHINGLE = 5
SIMILARITY = 0.8
SIZE = 128
BAND = 5
BANDS = SIZE // BAND
#: Shingles of the texts on either side that one group compares with each other.
BLOCK_WORDS = 400_000


def bags(col: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows: row, shingle and weight of each element, sorted by row; and two hashes of each row's words."""
    words, rows = word_hashes(col)
    n = len(rows) - 1
    ok = in_row(rows, k)
    row = row_of(rows)
    shingles = grams(words, k)[ok] if len(ok) else np.zeros(0, np.uint64)
    owner = row[: len(ok)][ok]
    lengths = np.diff(rows)
    # The words in their order; a text of fewer than k words is one shingle of all of them.
    place = np.arange(len(words), dtype=np.uint64) - np.repeat(rows[:-1], lengths).astype(np.uint64)
    whole = []
    for seed in (11, 23):
        total = np.zeros(n, np.uint64)
        np.add.at(total, row, mix(words + mix(place + np.uint64(seed * 0x51ED270B9F2D))))
        whole.append(mix(total + lengths.astype(np.uint64)))
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    owner, shingles = np.concatenate([owner, short]), np.concatenate([shingles, whole[0][short]])
    order = np.lexsort((shingles, owner))
    owner, shingles = owner[order], shingles[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (shingles[1:] != shingles[:-1])
    at = np.flatnonzero(first)
    return owner[at], shingles[at], np.diff(np.append(at, len(owner))), np.stack(whole, 1)


def _chance(seeds: np.ndarray) -> np.ndarray:
    return ((mix(seeds) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def smallest(similarity: float) -> int:
    """The least size of a bag to which a bag of another size can be similar."""
    n = 1
    while n < similarity * (n + 1):
        n += 1
    return n


def signed(owner: np.ndarray, shingles: np.ndarray, weights: np.ndarray, n: int, least: int) -> np.ndarray:
    """signatures(), but for bags of fewer than least shingles, which hash as a whole."""
    sizes = np.bincount(owner, weights, n)
    small = sizes[owner] < least
    found = signatures(owner[~small], shingles[~small], weights[~small], n)
    whole = np.zeros(n, np.uint64)
    np.add.at(whole, owner[small], mix(shingles[small] + mix(weights[small].astype(np.uint64))))
    rows = np.unique(owner[small])
    found[rows] = (mix(whole[rows, None] + np.arange(1, SIZE + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
    return found


def signatures(owner: np.ndarray, shingles: np.ndarray, weights: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """An n x size table of 32-bit components; rows without elements are zeros."""
    levels = np.zeros(len(weights), np.int64)
    reached = np.maximum(weights - 1, 0)
    while (reached > 0).any():
        levels += reached > 0
        reached = reached >> 1
    # Unit j of an element: the interval [0, 1) for j = 0, then [2 ** (j - 1), 2 ** j).
    repeat = levels + 1
    at = np.repeat(np.arange(len(owner)), repeat)
    level = np.arange(len(at)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1)
    row, limit = owner[at], weights[at]
    state = mix(shingles[at] + mix(level.astype(np.uint64) + np.uint64(101)))
    time = np.zeros(len(at))
    best = np.full(n * size, np.inf)
    part = np.zeros(n, bool)
    part[owner] = True
    active, step = np.arange(len(at)), 0
    while len(active):
        step += 1
        s = mix(state[active] + np.uint64(step * 0x9FB21C651E98DF25 % 2**64))
        time[active] += -np.log(_chance(s)) / width[active]
        cell = row[active] * size + (mix(s + np.uint64(1)) >> np.uint64(33)).astype(np.int64) % size
        y = low[active] + (_chance(s + np.uint64(2)) * width[active]).astype(np.int64)
        counts = y < limit[active]
        np.minimum.at(best, cell[counts], time[active][counts].astype(np.float32))
        rows, where = np.unique(row[active], return_inverse=True)
        latest = best.reshape(n, size)[rows].max(1)
        active = active[time[active] <= latest[where]]
    found = (mix(best.view(np.uint64)) >> np.uint64(32)).astype(np.uint32).reshape(n, size)
    found[~part] = 0
    return found


def _signed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owner, shingles, weights, whole = bags(batch["text"])
            found = signed(owner, shingles, weights, batch.num_rows, least)
            sizes = np.bincount(owner, weights, batch.num_rows).astype(np.int64)
            signs = [x.tobytes() if some else None for x, some in zip(found, sizes > 0, strict=True)]
            columns = [pa.array(whole[:, j].view(np.int64)) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch["doc"], *columns, pa.array(sizes), pa.array(signs, pa.binary())], names=["doc", "k1", "k2", "n", "sign"])

    return run


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        signs = np.frombuffer(b"".join(batch["sign"].to_pylist()), "<u4").reshape(-1, SIZE).astype(np.uint64)
        keys = np.empty((len(signs), BANDS), np.uint64)
        for b in range(BANDS):
            key = np.full(len(signs), b + 1, np.uint64)
            for j in range(b * BAND, (b + 1) * BAND):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signs[:, j])
            keys[:, b] = key
        rest = [pa.array(np.repeat(batch[c].to_numpy(), BANDS)) for c in ("doc", "n")]
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), *rest], names=["key", "doc", "n"])


def _bag_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's bag as a sorted set: the i-th of equal shingles has a name of its own."""
    for batch in slices(batches):
        owner, shingles, weights, _ = bags(batch["text"])
        at = np.repeat(np.arange(len(owner)), weights)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(weights) - weights, weights)
        names = np.where(nth > 0, mix(shingles[at] + mix(nth.astype(np.uint64))), shingles[at])
        row = owner[at]
        names = names[np.lexsort((names, row))]
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
        sets = [names[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(sets, pa.binary())], names=["doc", "bag"])


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch["bag_a"], batch["bag_b"], strict=True):
                a, b = (np.frombuffer(s.as_buffer(), "<u8") for s in (x, y))
                shared = 0
                if min(len(a), len(b)) >= similarity * max(len(a), len(b)):
                    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
                    shared = int((a[at] == b).sum())
                kept.append(shared >= similarity * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def _root(parent: dict[int, int], x: int) -> int:
    while (up := parent.get(x, x)) != x:
        parent[x] = parent.get(up, up)
        x = up
    return x


def _compared(similarity: float):
    """Links between classes: each left text of a group with all of its right ones, no more than join their classes."""

    def run(table: pa.Table) -> pa.Table:
        doc, label = table["doc"].to_numpy(), table["label"].to_numpy()
        left = np.array(table["left"].to_pylist(), bool)
        bags = [np.frombuffer(x.as_buffer(), "<u8") for x in table["bag"]]
        sizes = np.array([len(x) for x in bags])
        right = np.flatnonzero(~left)
        postings = np.concatenate([np.zeros(0, np.uint64), *[bags[i] for i in right]])
        holder = np.repeat(right, sizes[right])
        order = np.argsort(postings, kind="stable")
        postings, holder = postings[order], holder[order]
        parent: dict[int, int] = {}
        links = []
        todo = np.flatnonzero(left)
        for i in todo[np.argsort(doc[todo], kind="stable")].tolist():
            lo, hi = (np.searchsorted(postings, bags[i], side) for side in ("left", "right"))
            many = hi - lo
            at = np.arange(many.sum()) + np.repeat(lo - (np.cumsum(many) - many), many)
            shared = np.bincount(holder[at], minlength=len(doc))
            near = np.flatnonzero((shared > 0) & (shared >= similarity * (sizes + sizes[i] - shared)))
            for k in np.unique(label[near]).tolist():
                a, b = _root(parent, int(label[i])), _root(parent, k)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    links.append((int(label[i]), k))
        return pa.table([pa.array([x[j] for x in links], pa.int64()) for j in (0, 1)], names=["a", "b"])

    return run


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as (a, b): each number but the least of what hangs together there, and that least one.

    foreign: a was the smaller number of all its links here, so that another task may know it too.
    """
    parent: dict[int, int] = {}
    own: set[int] = set()
    for batch in batches:
        own.update(batch["a"].to_pylist())
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            a, b = _root(parent, a), _root(parent, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    found = [(a, _root(parent, a), a not in own) for a in sorted(parent)]
    kinds = (pa.int64(), pa.int64(), pa.bool_())
    yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], kind) for j, kind in enumerate(kinds)], names=["a", "b", "foreign"])


def labelled(links: DataFrame) -> DataFrame:
    """(doc, label) of linked numbers, without those that are the least of their class, which is the label.

    links has a and b. In each round, tasks join the links that they hold, by the larger number, so that a
    number points to one smaller number; then each points on to what that one points to. What many numbers
    point to is looked up by a join, whose hot keys Spark splits. It ends when no number is known to two
    tasks and none points on.
    """
    spark = links.sparkSession
    edges, before = links.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b"), []
    while True:
        met = written(edges.repartition("a").mapInArrow(_contracted, "a long, b long, foreign boolean"), "met")
        dropped(spark, *before)
        least = written(met.groupBy("a").agg(F.min("b").alias("m")), "least")
        after = met.join(least.selectExpr("a AS b", "m"), "b", "left").selectExpr("a", "coalesce(m, b) AS b", "foreign OR m IS NOT NULL AS moved")
        edges = written(after, "onward")
        dropped(spark, met, least)
        before = [edges]
        if edges.where("moved").isEmpty():
            return edges.selectExpr("a AS doc", "b AS label")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and copy_of (the least doc_id of the same words)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("doc IS NOT NULL")
    signs = written(texts.mapInArrow(_signed(smallest(similarity)), "doc long, k1 long, k2 long, n long, sign binary"), "signatures")
    reps = written(signs.groupBy("k1", "k2").agg(F.min("doc").alias("doc"), F.min("n").alias("n"), F.min("sign").alias("sign")), "texts")
    copies = written(signs.select("doc", "k1", "k2").join(reps.selectExpr("k1", "k2", "doc AS rep"), ["k1", "k2"]).select("doc", "rep"), "copies")
    dropped(spark, signs)
    bands = reps.where("sign IS NOT NULL").select("doc", "n", "sign").mapInArrow(_banded, "key long, doc long, n long")
    # Counts are written, so that the join deals out both of its sides by itself and splits a hot bucket.
    counts = written(bands.groupBy("key").agg(F.count("*").alias("size"), F.min("doc").alias("pivot")).where("size > 1").drop("size"), "band-counts")
    held = written(bands.join(counts, "key"), "buckets")
    dropped(spark, reps, counts)
    # The hint keeps the plan the same at every size.
    sets = written(texts.join(held.select("doc").hint("merge"), "doc", "left_semi").mapInArrow(_bag_sets, "doc long, bag binary"), "bags")
    pairs = held.where("doc <> pivot").selectExpr("pivot AS a", "doc AS b").distinct()
    pairs = pairs.join(sets.selectExpr("doc AS b", "bag AS bag_b"), "b").join(sets.selectExpr("doc AS a", "bag AS bag_a"), "a")
    stars = written(pairs.select("a", "b", "bag_a", "bag_b").mapInArrow(_verified(similarity), "a long, b long"), "similar")
    first = labelled(stars)
    known = held.join(first, "doc", "left").join(first.selectExpr("doc AS pivot", "label AS main"), "pivot", "left")
    known = known.selectExpr("doc", "n", "coalesce(label, doc) AS label", "coalesce(main, pivot) AS main")
    members = written(known.groupBy("main", "doc", "label").agg(F.max("n").alias("n")), "members")
    dropped(spark, held, stars)
    sizes = members.groupBy("main").agg(F.sum(F.expr("CASE WHEN label <> main THEN n END")).alias("rest"), F.sum("n").alias("words")).where("rest > 0")
    sizes = written(sizes.selectExpr("main", f"cast(ceil(rest / {BLOCK_WORDS}) AS int) AS lefts", f"cast(ceil(words / {BLOCK_WORDS}) AS int) AS rights"), "blocks")
    rows = members.join(sizes, "main").join(sets, "doc")
    left = "CASE WHEN label <> main THEN transform(sequence(0, rights - 1), j -> struct(true AS left, cast(pmod(xxhash64(doc), lefts) AS int) AS i, j AS j)) ELSE array() END"
    right = "transform(sequence(0, lefts - 1), i -> struct(false AS left, i AS i, cast(pmod(xxhash64(doc, 7), rights) AS int) AS j))"
    rows = rows.selectExpr("main", "doc", "label", "bag", f"inline(concat({left}, {right}))")
    links = written(rows.groupBy("main", "i", "j").applyInArrow(_compared(similarity), "a long, b long"), "links")
    dropped(spark, members, sizes, sets)
    # Texts of one doc_id are linked.
    ids = written(copies.groupBy("doc").agg(F.min("rep").alias("rep"), F.max("rep").alias("last")), "ids")
    same = copies.join(ids.where("rep <> last").selectExpr("doc", "rep AS a"), "doc").join(first.selectExpr("doc AS a", "label AS label_a"), "a", "left").join(first.selectExpr("doc AS rep", "label AS label_b"), "rep", "left")
    second = labelled(links.unionByName(same.selectExpr("coalesce(label_a, a) AS a", "coalesce(label_b, rep) AS b")))
    labels = first.join(second.selectExpr("doc AS label", "label AS last"), "label", "left").selectExpr("doc AS rep", "coalesce(last, label) AS label").unionByName(second.selectExpr("doc AS rep", "label"))
    dropped(spark, copies, links)
    found = ids.select("doc", "rep").join(labels, "rep", "left")
    return found.select(F.col("doc").alias("doc_id"), F.coalesce("label", "rep").alias("class_id"), F.col("rep").alias("copy_of"))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose doc_id is the least of its class, with their own columns; rows of null doc_id stay.

    Which rows go is few and written, so a join decides that Spark can split.
    """
    with temporary(docs.sparkSession) as keep:
        gone = keep(written(classes(docs.select("doc_id", "text"), similarity).where("class_id <> doc_id").select(F.col("doc_id").alias("gone")), "gone"))
    return docs.join(gone.hint("merge"), docs["doc_id"].cast("long") == gone["gone"], "left_anti")
