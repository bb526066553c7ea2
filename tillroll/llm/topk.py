"""Exact top-k search by inner product with a pivot table.

Distances from every vector to a few pivots are computed once and stored.  By the
triangle inequality ``|d(q, p) - d(v, p)|`` bounds d(q, v) from below, the
greatest over all pivots most tightly, and with it the inner product from above:
``<q, v> <= (|q|^2 + |v|^2 - bound^2) / 2``.  A task keeps each query's best k so
far, takes candidates in the order of their bounds and stops a query once the
next bound is below its k-th score.  Queries go to the tasks in blocks of
bounded size, one pass over the table for each block.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.llm.shared import stored, tune

#: Queries of one pass (their vectors go to every task), pivots, the sample that
#: pivots are taken from, and candidates evaluated at a time.
QUERY_BLOCK, PIVOTS, PIVOT_SAMPLE, CHUNK = 32_768, 16, 2_048, 32


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): components floor(scale * x), x as double.  Rows without vec_id
    or vector, or with a null or non-finite component, are left out."""
    largest = F.lit(float(np.finfo(np.float64).max))
    return (vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL")
            .where(F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= largest)))
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
                    .alias("v")))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each next pivot is the sample vector farthest from all so far."""
    picked = [0]
    gap = np.linalg.norm(sample - sample[0], axis=1)
    while len(picked) < min(count, len(sample)) and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(sample - sample[picked[-1]], axis=1))
    return sample[picked]


def _matrix(column: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    return np.array(column.take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), width)


def _widths(column: pa.Array) -> np.ndarray:
    return np.array(pc.list_value_length(column), np.int64)


def _pivot_distances(pivots: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            column = batch.column("v")
            widths, out = _widths(column), [None] * batch.num_rows
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                m = _matrix(column, rows, width)
                known = pivots.get(int(width), np.zeros((0, width)))
                d = np.stack([np.linalg.norm(m - p, axis=1) for p in known], 1) if len(known) else \
                    np.zeros((len(rows), 0))
                for r, x in zip(rows.tolist(), d):
                    out[r] = x
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), column, pa.array(out, pa.list_(pa.float64()))],
                names=["vec_id", "v", "d"])
    return run


def _scores(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products as long (saturated where they don't fit one)."""
    if m.size and np.abs(m).max() * np.abs(q).max(initial=0) * m.shape[1] < 2**53:
        return (m @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in m]
    return np.array([min(max(x, -2**63), 2**63 - 1) for x in exact], np.int64)


class _Best:
    """The k best of each query of one width: score down, then vec_id up."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, distances: np.ndarray, k: int):
        self.ids, self.vectors, self.distances, self.k = ids, vectors, distances, k
        self.norms = (vectors**2).sum(1)
        self.top: list[tuple[np.ndarray, np.ndarray]] = [
            (np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        self.floor = np.full(len(ids), -np.inf)

    def take(self, vec_ids: np.ndarray, m: np.ndarray, distances: np.ndarray) -> None:
        norms = (m**2).sum(1)
        low = np.zeros((len(self.ids), len(m)))
        for p in range(distances.shape[1]):
            np.maximum(low, np.abs(self.distances[:, p, None] - distances[None, :, p]), out=low)
        slack = 1e-9 * (np.sqrt(self.norms)[:, None] + np.sqrt(norms)[None, :] + 1)
        low = np.maximum(low - slack, 0)
        high = (self.norms[:, None] + norms[None, :] - low**2) / 2
        high += 1e-9 * (np.abs(high) + self.norms[:, None] + norms[None, :]) + 1e-6
        for i in np.flatnonzero((high >= self.floor[:, None]).any(1)).tolist():
            left = np.flatnonzero((high[i] >= self.floor[i]) & (vec_ids != self.ids[i]))
            left = left[np.argsort(-high[i, left], kind="stable")]
            at = 0
            while at < len(left) and high[i, left[at]] >= self.floor[i]:
                some = left[at:at + CHUNK]
                at += CHUNK
                ids = np.concatenate((self.top[i][0], vec_ids[some]))
                scores = np.concatenate((self.top[i][1], _scores(m[some], self.vectors[i])))
                best = np.lexsort((ids, -scores))[:self.k]
                self.top[i] = ids[best], scores[best]
                if len(best) == self.k:
                    self.floor[i] = scores[best[-1]]


def _search(block, k: int):
    def run(batches):
        best = {width: _Best(*of, k) for width, of in block.value.items()}
        for batch in batches:
            ids = np.array(batch.column("vec_id"), np.int64)
            widths = _widths(batch.column("v"))
            for width in np.unique(widths).tolist():
                if width in best:
                    rows = np.flatnonzero(widths == width)
                    pivots = best[width].distances.shape[1]
                    best[width].take(ids[rows], _matrix(batch.column("v"), rows, width),
                                     _matrix(batch.column("d"), rows, pivots))
        for b in best.values():
            sizes = [len(t[0]) for t in b.top]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(b.ids, sizes)), pa.array(np.concatenate([t[0] for t in b.top])),
                     pa.array(np.concatenate([t[1] for t in b.top]))], names=["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` greatest integer inner products of
    every row for which the condition ``is_query`` holds with all rows of another
    vec_id (all, if fewer); ties go to the smaller vec_id.

    ``vectors``: vec_id, embedding; other columns are ignored.  Vectors are
    compared with those of equal length.  A repeated query counts once, repeated
    candidates each.  Rows that :func:`quantised` leaves out take no part; an
    empty table has no results.
    """
    spark = tune(vectors.sparkSession)
    ints = quantised(vectors, scale)
    sample = (ints.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("v").toArrow()
              .column("v").combine_chunks())
    widths = _widths(sample)
    pivots = {int(w): choose_pivots(_matrix(sample, np.flatnonzero(widths == w), w), PIVOTS)
              for w in np.unique(widths)}
    table = stored(ints.mapInArrow(_pivot_distances(pivots), "vec_id long, v array<double>, d array<double>"),
                   "pivot-table")
    queries = stored(table.where(is_query).dropDuplicates(["vec_id", "v"]), "queries")
    blocks = -(-queries.count() // QUERY_BLOCK)
    found = []
    for b in range(blocks):
        chosen = queries.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)) == b).toArrow()
        ids = np.array(chosen.column("vec_id"), np.int64)
        v, d = (chosen.column(c).combine_chunks() for c in ("v", "d"))
        widths, block = _widths(v), {}
        for w in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == w)
            block[w] = ids[rows], _matrix(v, rows, w), _matrix(d, rows, len(pivots.get(w, ())))
        found.append(table.mapInArrow(_search(spark.sparkContext.broadcast(block), k),
                                      "query_id long, vec_id long, score long"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
