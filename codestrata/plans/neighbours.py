"""Exact nearest neighbours: every query against every row of the base, in blocks.

Queries go to the workers in slices of bounded size, each slice being one pass over the base. A
task keeps the best rows of its part for each query; the parts' best are merged by a
window, which Spark also cuts down before it shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

SLICE = 16 << 20        # bytes of query vectors sent at a time
CELLS = 1 << 21         # distances a task holds at a time


class Best:
    """The k nearest rows so far of each query of one length."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.k = queries, k
        self.of = np.zeros(0, np.int64)         # query, distance and id of each kept row
        self.far, self.ids = np.zeros(0), np.zeros(0, np.int64)
        self.least = np.full(len(queries), np.inf)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Look at more rows: roughly by one product of matrices, exactly where that comes near the best."""
        step = max(1, CELLS // max(1, len(self.queries)))
        for at in range(0, len(rows), step):
            part, names = rows[at:at + step], ids[at:at + step]
            square = (part ** 2).sum(axis=1)
            rough = square[:, None] - 2 * part @ self.queries.T + (self.queries ** 2).sum(axis=1)
            room = 1e-9 * (1 + square[:, None] + np.abs(rough))
            most = self.least
            if len(part) > self.k:
                most = np.minimum(most, np.partition(rough, self.k - 1, axis=0)[self.k - 1])
            row, query = np.nonzero(rough - room <= most + room.max())
            exact = ((part[row] - self.queries[query]) ** 2).sum(axis=1)
            self._merge(query, exact, names[row])

    def _merge(self, of: np.ndarray, far: np.ndarray, ids: np.ndarray) -> None:
        of, far, ids = np.concatenate([self.of, of]), np.concatenate([self.far, far]), np.concatenate([self.ids, ids])
        order = np.lexsort([ids, far, of])
        of, far, ids = of[order], far[order], ids[order]
        first = np.searchsorted(of, of)
        keep = np.arange(len(of)) - first < self.k
        self.of, self.far, self.ids = of[keep], far[keep], ids[keep]
        full = np.flatnonzero(np.bincount(self.of, minlength=len(self.queries)) == self.k)
        last = np.searchsorted(self.of, full, "right") - 1
        self.least[full] = self.far[last]


def _vectors(column: pa.Array, ids: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the usable rows, by length."""
    usable = pc.and_(pc.fill_null(pc.greater(pc.list_value_length(column), 0), False), ids.is_valid())
    column, ids = column.filter(usable), ids.filter(usable).to_numpy()
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    cut = np.concatenate([[0], np.cumsum(sizes)])
    for size in np.unique(sizes):
        which = np.flatnonzero(sizes == size)
        rows = flat[cut[which][:, None] + np.arange(size)]
        whole = np.isfinite(rows).all(axis=1)
        yield ids[which][whole], rows[whole]


def nearest(base: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """(query, rank, id, distance) of the ``k`` rows of ``base`` nearest to each query, equal ones by id.

    Both have id and vector; distances are squared and Euclidean, from the query as a unit vector to the base as it
    is. A null vector, one with a null or a number that isn't finite, and a null id take no part; a query only meets
    rows of its length and may have fewer than ``k``. A query of zeros stays one. Repeated ids are rows of their own.
    """
    spark = base.sparkSession
    size = queries.agg(F.sum(8 * F.size("vector"))).first()[0] or 0
    slices = int(-(-2 * size // SLICE)) or 1            # hashed slices are even to a factor well under two
    out = None
    for s in range(slices):
        table = queries.filter(F.pmod(F.xxhash64("id"), F.lit(slices)) == s).select("id", "vector").toArrow()
        held = []
        for ids, rows in _vectors(table["vector"].combine_chunks(), table["id"].combine_chunks()):
            norm = np.sqrt((rows ** 2).sum(axis=1, keepdims=True))
            held.append((ids, rows / np.where(norm > 0, norm, 1)))
        sent = spark.sparkContext.broadcast(held)

        def run(batches, sent=sent):
            best = {q.shape[1]: (ids, Best(q, k)) for ids, q in sent.value}
            for batch in batches:
                for ids, rows in _vectors(batch.column(1), batch.column(0)):
                    if rows.shape[1] in best and len(rows):
                        best[rows.shape[1]][1].add(ids, rows)
            for names, b in best.values():
                yield pa.RecordBatch.from_arrays([pa.array(names[b.of]), pa.array(b.of), pa.array(b.ids), pa.array(b.far)],
                                                 names=["query", "n", "id", "distance"])

        got = base.select("id", "vector").mapInArrow(run, "query long, n long, id long, distance double")
        order = Window.partitionBy("query", "n").orderBy("distance", "id")
        got = got.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "rank", "id", "distance")
        out = got if out is None else out.unionByName(got)
    return out
