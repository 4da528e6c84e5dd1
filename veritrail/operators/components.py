"""Connected components and shortest paths over edge tables, in rounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Edges that a task joins up at once.
SLICE_EDGES = 4 << 20
_OUT_ROWS = 1 << 16


def _folder(df: DataFrame) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of our own on a single machine, and an error on a cluster."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master.partition("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = f"{tempfile.gettempdir()}/veritrail-checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    _folder(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table beside the checkpoints: lineage ends here, and a plan reads only the columns that it names."""
    path = f"{_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _mixed(ids: np.ndarray, turn: int) -> np.ndarray:
    """A bijection of 64-bit numbers, another one for each turn."""
    h = ids.astype(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(by)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of the component of each of n nodes, which edges join."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while not np.array_equal(further := root[root], root):
            root = further
        a, b = root[low], root[high]
        apart = a != b
        a, b = a[apart], b[apart]
    return root


def _stars(turn: int, limit: int):
    """For mapInArrow: each node x of a slice of edges, with the root y of its component there, a number of the next turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def joined() -> Iterator[pa.RecordBatch]:
            a, b = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            held.clear()
            ids = np.concatenate([a, b])
            mixed, first, place = np.unique(_mixed(ids, turn), return_index=True, return_inverse=True)
            x, y = ids[first], mixed[_roots(place[: len(a)], place[len(a) :], len(mixed))]
            for at in range(0, len(x), _OUT_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + _OUT_ROWS]), pa.array(y[at : at + _OUT_ROWS])], names=["x", "y"])

        for batch in batches:
            # Copies, as a batch's memory is Spark's.
            held.append([batch.column(i).to_numpy(zero_copy_only=False).copy() for i in (0, 1)])
            size += batch.num_rows
            if size >= limit:
                yield from joined()
                size = 0
        if size:
            yield from joined()

    return run


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node and component (its least node) from edges a, b of whole numbers; a self edge makes a lone node known, one with a null end is none.

    Edges are dealt out by one end and joined up slice by slice. A node then has as many roots as there are slices
    that know it, and one of them, its least, stands for it: only edges from there to its other roots are left for
    the next round. All edges move twice, in the first round. They are sorted, so that a task run again finds the
    same slices. Numbers are mixed anew in each round, so that no numbering keeps a graph from shrinking; the last
    edges fit one slice, which leaves none.
    """
    edges = edges.selectExpr("cast(a AS bigint) AS a", "cast(b AS bigint) AS b").where("a IS NOT NULL AND b IS NOT NULL")
    steps, dealt = [], edges.hint("rebalance", "a").sortWithinPartitions("a", "b")
    for turn in range(rounds):
        stars = dealt.mapInArrow(_stars(turn, SLICE_EDGES), "x long, y long")
        by = Window.partitionBy("x").orderBy("y")
        ranked = stars.select("x", "y", F.min("y").over(by).alias("root"), (F.row_number().over(by) == 1).alias("first")).where("first OR y <> root")
        found = written(ranked.selectExpr("CASE WHEN first THEN x END AS node", "root", "CASE WHEN NOT first THEN y END AS other"))
        steps.append(found.where("node IS NOT NULL").select("node", "root"))
        left = written(found.where("other IS NOT NULL").selectExpr("root AS a", "other AS b").distinct())
        if not (n := left.count()):
            break
        dealt = left.coalesce(1) if n <= SLICE_EDGES else left.hint("rebalance", "a").sortWithinPartitions("a", "b")
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    roots = steps.pop()
    while steps:
        further = roots.selectExpr("node AS root", "root AS further")
        roots = steps.pop().join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        if not steps:
            roots = written(roots)
    least = written(roots.groupBy("root").agg(F.min("node").alias("component")))
    return roots.join(least, "root").select("node", "component")


def shortest_paths(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """origin, node, distance and path (array of nodes) within hops of sources (origin); of equal paths the least."""
    sides = edges.selectExpr("a AS x", "b AS y").unionByName(edges.selectExpr("b AS x", "a AS y")).distinct()
    front = sources.select("origin", F.col("origin").alias("node"), F.lit(0).alias("distance"), F.array("origin").alias("path"))
    reached = front = cut(front)
    for hop in range(1, hops + 1):
        step = front.join(sides, front["node"] == sides["x"]).select("origin", F.col("y").alias("node"), F.lit(hop).alias("distance"), F.concat("path", F.array("y")).alias("path"))
        step = step.groupBy("origin", "node").agg(F.min("distance").alias("distance"), F.min("path").alias("path"))
        front = cut(step.join(reached.select("origin", "node"), ["origin", "node"], "left_anti"))
        if front.isEmpty():
            break
        reached = cut(reached.unionByName(front))
    return reached


def distances(sides: DataFrame | list[DataFrame], sources: DataFrame, hops: int) -> DataFrame:
    """origin, node and hops (their distance) within hops edges of sources (origin); sides has each edge (x, y) in both directions.

    One table of sides is written once; a list has one for each round, of the edges that its front can have, and
    isn't written. A round joins its front alone, and what is reached is written by round but for the last. A hub's
    edges are one side of a join whose hot keys Spark splits.
    """
    if isinstance(sides, DataFrame):
        sides = [cut(sides.distinct())] * hops
    front = cut(sources.select("origin", F.col("origin").alias("node"), F.lit(0).cast("bigint").alias("hops")).distinct())
    reached = front
    for hop in range(1, hops + 1):
        step = front.select("origin", F.col("node").alias("x")).join(sides[hop - 1], "x").select("origin", F.col("y").alias("node")).distinct()
        front = step.join(reached.select("origin", "node"), ["origin", "node"], "left_anti").select("origin", "node", F.lit(hop).cast("bigint").alias("hops"))
        if hop < hops:
            front = cut(front)
        reached = reached.unionByName(front)
    return reached
