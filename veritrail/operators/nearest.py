"""The nearest vectors by cosine, block against block."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrail.operators.components import cut

#: Numbers in a block of vectors, and in one of those searched for.
BLOCK, ASKED_BLOCK = 1 << 20, 1 << 19
#: Cosines that a task has at once, and pairs that it takes exactly at once.
_CELLS, _PAIRS = 1 << 21, 1 << 18
_SCHEMA = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("cosine", pa.float64())])


def _matrices(col: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the rows of that length, and their vectors as columns."""
    lists = pa.concat_arrays([c.cast(pa.large_list(pa.float64())) for c in col.chunks]) if col.num_chunks else pa.array([], pa.large_list(pa.float64()))
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    return {int(d): (rows := np.flatnonzero(sizes == d), values[offsets[rows] + np.arange(d)[:, None]]) for d in np.unique(sizes) if d}


def _dots(a: np.ndarray, b: np.ndarray, i=slice(None), j=slice(None)) -> np.ndarray:
    """Products of columns i of a and j of b, summed in the order of their places, as SQL does."""
    total = np.zeros(len(a[0][i]))
    for x, y in zip(a, b, strict=True):
        total += x[i] * y[j]
    return total


def _units(x: np.ndarray) -> np.ndarray:
    """x in ten-thousandths, rounded half up by its decimal digits, as SQL does; infinite for NaN, which sorts as the greatest."""
    y = x * 10_000
    out = np.floor(y + 0.5)
    near = np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6)
    if len(near):
        found, place = np.unique(x[near], return_inverse=True)
        exact = [float(Decimal(repr(float(v))).quantize(Decimal("0.0001"), ROUND_HALF_UP) * 10_000) for v in found]
        out[near] = np.array(exact)[place]
    return np.where(np.isnan(x), np.inf, out)


def _first(n: int, row: np.ndarray, units: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Indices of each row's n entries of most units, the least ranks of equals."""
    order = np.lexsort((rank, -units, row))
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row) < n]


def _met(asked: np.ndarray, vectors: np.ndarray, rank: np.ndarray, n: int, above: float) -> list[np.ndarray]:
    """Columns of asked and of vectors that meet, and their rounded cosine in ten-thousandths: n for each of asked at most, all above."""
    norms = [np.sqrt(_dots(m, m)) for m in (asked, vectors)]
    # A norm that isn't a number stays, as in SQL.
    kept = [np.flatnonzero(norm != 0) for norm in norms]
    asked, vectors = (m[:, k] for m, k in zip((asked, vectors), kept, strict=True))
    norms = [norm[k] for norm, k in zip(norms, kept, strict=True)]
    rank = rank[kept[1]]
    unit, others = np.ascontiguousarray((asked / norms[0]).T), vectors / norms[1]
    found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    step = max(1, _CELLS // max(1, len(unit)))
    for at in range(0, others.shape[1], step):
        # Far more than what rounding or another order of summing makes of a cosine.
        row, col = np.nonzero(~(unit @ others[:, at : at + step] < above - 1e-4))
        for first in range(0, len(row), _PAIRS):
            i, j = row[first : first + _PAIRS], col[first : first + _PAIRS] + at
            units = _units(_dots(asked, vectors, i, j) / (norms[0][i] * norms[1][j]))
            over = units / 10_000 > above
            merged = [np.concatenate(c) for c in zip(found, (i[over], j[over], units[over]), strict=True)]
            best = _first(n, merged[0], merged[2], rank[merged[1]])
            found = [c[best] for c in merged]
    return [kept[0][found[0]], kept[1][found[1]], found[2]]


def _block(n: int, above: float):
    """For applyInArrow: of each vector asked for, its n nearest in one block."""

    def run(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        # Null ids come last.
        rank = np.empty(vectors.num_rows, np.int64)
        rank[pc.sort_indices(vectors["vec_id"]).to_numpy()] = np.arange(vectors.num_rows)
        ours, theirs = _matrices(asked["embedding"]), _matrices(vectors["embedding"])
        parts = [_SCHEMA.empty_table()]
        with np.errstate(all="ignore"):
            for d in ours.keys() & theirs.keys():
                (rows, a), (others, b) = ours[d], theirs[d]
                i, j, units = _met(a, b, rank[others], n, above)
                cosine = np.where(np.isinf(units), np.nan, units / 10_000)
                parts.append(pa.table([asked["qid"].take(pa.array(rows[i])), vectors["vec_id"].take(pa.array(others[j])), pa.array(cosine)], schema=_SCHEMA))
        return pa.concat_tables(parts)

    return run


def nearest(asked: DataFrame, vectors: DataFrame, n: int, above: float) -> DataFrame:
    """qid, vec_id and cosine, rounded to four digits: for each qid of asked (qid, embedding) the n nearest of vectors (vec_id, embedding), the least vec_id of equals, those above a bound.

    Every vector asked for meets every vector, in blocks of bounded size whose pairs are dealt out over all tasks.
    A product of matrices finds the pairs that may be above the bound; these are then summed as SQL sums them.
    """
    whole = "size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL)"
    asked, vectors = cut(asked.where(whole)), vectors.where(whole)
    blocks = [max(1, -(-(df.agg(F.sum(F.size("embedding"))).first()[0] or 0) // size)) for df, size in ((vectors, BLOCK), (asked, ASKED_BLOCK))]
    # Each row gets one block of its own side, and meets all of the other.
    own = lambda i: (F.monotonically_increasing_id() % blocks[i]).cast("int")
    every = lambda i: F.explode(F.sequence(F.lit(0), F.lit(blocks[i] - 1)))
    left = vectors.select(own(0).alias("i"), "vec_id", "embedding").select("i", every(1).alias("j"), "vec_id", "embedding")
    right = asked.select(own(1).alias("j"), "qid", "embedding").select(every(0).alias("i"), "j", "qid", "embedding")
    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_block(n, above), "qid long, vec_id long, cosine double")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cosine"), F.asc_nulls_last("vec_id")))
    return met.withColumn("place", place).where(F.col("place") <= n).drop("place")
