"""Ranked lexical search by trees of term vectors, for a table of items against all documents.

Every document becomes a vector of the terms that some item has, with their counts. For an
item the vectors are restricted to its terms, rarest first, and laid into a tree in which
equal beginnings share their path. A node knows the greatest count of each term and the
least length norm m among the documents below it, so the score that its documents can
reach is bounded by what its own terms give at those values. A depth-first walk passes over
every subtree whose bound is under the item's twentieth best score so far; documents at
the ends that remain are scored exactly.

Score of a document: the sum over the item's terms, repeats included, of
w * ((10^9 tf) div (1000 tf + 12 m)), w = floor(1000 ln((2 N + 2) / (2 df + 1))),
m = 75 + (25 n N) div L. All but w in 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .common import arrow_map

BEST = 20
SLICE = 4 << 20         # bytes of item texts sent to the workers at a time
ENTRIES = 1 << 21       # vector entries of the documents that share trees
CELLS = 1 << 20         # documents times terms of one tree
BLOCK = 256             # documents scored at a time in a walk

# what parts terms becomes a blank, A-Z their small letters; bytes over 0x7F are letters
_TERMS = bytes(b if b > 0x7F or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TERMS).split() if text else []


def vectors(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): a document's terms with repeats and its counts of numbered ones.

    Documents without a term are left out.
    """
    held = docs.sparkSession.sparkContext.broadcast(number)

    def count(c):
        get = held.value.get
        out = {k: [] for k in ("doc_id", "n", "terms", "counts")}
        for doc_id, text in zip(c["doc_id"], c["text"]):
            ts = terms_of(text)
            if not ts:
                continue
            seen = np.array([k for k in map(get, ts) if k is not None], np.int64)
            ks, counts = np.unique(seen, return_counts=True)
            for k, v in zip(out, (doc_id, len(ts), ks.tolist(), counts.tolist())):
                out[k].append(v)
        return out

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return arrow_map(texts, count, "doc_id long, n long, terms array<int>, counts array<int>")


def holders(rows: DataFrame) -> DataFrame:
    """(term, df): documents that hold each numbered term, added up within each partition first."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(total))
            got[:len(total)] += total
            total = got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "df"])

    return rows.select("terms").mapInArrow(add, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Item:
    """An item's distinct terms, rarest first, and what one occurrence of each weighs."""

    def __init__(self, terms: list[int], weight: dict[int, int], df: dict[int, int]) -> None:
        times: dict[int, int] = {}
        for t in terms:
            times[t] = times.get(t, 0) + 1
        # a term that no document holds, or that weighs nothing, adds to no score
        self.terms = np.array(sorted((t for t in times if weight.get(t, 0) > 0), key=lambda t: (df[t], t)), np.int64)
        self.weights = np.array([weight[t] * times[t] for t in self.terms.tolist()], np.int64)

    def scores(self, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        tf = tf.astype(np.int64)
        return (self.weights * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[:, None]))).sum(axis=1)

    def bounds(self, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """No less than the scores, and quicker: in doubles, with room for their rounding."""
        part = tf.astype(np.float64)
        part /= part * 1000 + (12.0 * m)[:, None]
        return part @ (self.weights * 1e9) * (1 + 1e-9) + 1


class Tree:
    """The tree of the vectors tf (documents by terms), nodes in depth-first order.

    node_tf and node_m: greatest counts and least m in each node's subtree. skip: the node
    after the subtree. leaf: the number of the distinct vector shape that ends at the node,
    or -1; docs[cut[leaf]:cut[leaf + 1]] have that shape.
    """

    def __init__(self, tf: np.ndarray, m: np.ndarray) -> None:
        n, width = tf.shape
        has = tf > 0
        # with all places behind a vector's last term set, it sorts before those that go on from it
        filled = has | (np.arange(width) >= width - has[:, ::-1].argmax(axis=1)[:, None])
        words = np.packbits(np.pad(~filled, ((0, 0), (0, -width % 64))), axis=1).view(">u8").astype(np.uint64)
        size = has.sum(axis=1)
        self.docs = np.lexsort([size, *words.T[::-1]])
        words, size, tf = words[self.docs], size[self.docs], tf[self.docs]
        new = np.ones(n, bool)
        new[1:] = (words[1:] != words[:-1]).any(axis=1) | (size[1:] != size[:-1])
        first = np.flatnonzero(new)
        self.cut = np.append(first, n)
        has, size = tf[first] > 0, size[first]
        differs = has[1:] != has[:-1]
        shared = np.zeros(len(first), np.int64)
        at = differs.argmax(axis=1)
        shared[1:] = (np.cumsum(has[1:], axis=1) - has[1:])[np.arange(len(at)), at]
        # a shape adds nodes for its terms behind those it shares with the shape before
        added = size - shared
        shape_of = np.repeat(np.arange(len(first)), added)
        depth = np.arange(len(shape_of)) - np.repeat(np.cumsum(added) - added, added) + shared[shape_of] + 1
        ends = depth == size[shape_of]
        self.leaf = np.where(ends, shape_of, -1)
        self.node_tf = np.zeros((len(depth), width), np.int32)
        self.node_m = np.full(len(depth), np.iinfo(np.int64).max, np.int64)
        self.node_tf[ends] = np.maximum.reduceat(tf, first, axis=0)
        self.node_m[ends] = np.minimum.reduceat(m[self.docs], first)
        self.skip = np.full(len(depth), len(depth), np.int64)
        self._gather(depth)

    def _gather(self, depth: np.ndarray) -> None:
        """Carry maxima and minima up, deepest nodes first, and find where each subtree ends."""
        order = np.argsort(depth, kind="stable")
        bounds = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 2))
        levels = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for k, nodes in enumerate(levels):
            # the subtree ends at the next node that is no deeper
            nearest = self.skip[levels[k - 1]][np.searchsorted(levels[k - 1], nodes) - 1] if k else len(depth)
            self.skip[nodes] = np.minimum(np.append(nodes[1:], len(depth)), nearest)
        for k in range(len(levels) - 1, 0, -1):
            nodes = levels[k]
            parent = np.searchsorted(levels[k - 1], nodes) - 1
            start = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
            up = levels[k - 1][parent[start]]
            below = np.maximum.reduceat(self.node_tf.take(nodes, axis=0), start, axis=0)
            self.node_tf[up] = np.maximum(self.node_tf.take(up, axis=0), below)
            self.node_m[up] = np.minimum(self.node_m[up], np.minimum.reduceat(self.node_m[nodes], start))


class Best:
    """The best (score, document) pairs so far of one item."""

    def __init__(self) -> None:
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known = np.zeros(0, bool)      # whether the document has an id; those without come last

    @property
    def least(self) -> int:
        """A score that is reached by whatever can still enter; scores of 0 never do."""
        return int(self.scores[-1]) if len(self.scores) == BEST else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        keep = scores >= self.least
        scores, ids, known = (np.concatenate(x) for x in (
            (self.scores, scores[keep]), (self.ids, ids[keep]), (self.known, known[keep])))
        order = np.lexsort([ids, ~known, -scores])[:BEST]
        self.scores, self.ids, self.known = scores[order], ids[order], known[order]


def walk(item: Item, tree: Tree, tf: np.ndarray, m: np.ndarray, ids: np.ndarray, known: np.ndarray, best: Best) -> int:
    """Depth first through the tree past subtrees whose bound is too low; returns the documents scored."""
    bound = item.bounds(tree.node_tf, tree.node_m).tolist()
    skip, leaf = tree.skip.tolist(), tree.leaf.tolist()
    waiting: list[np.ndarray] = []
    n, scored, v, least = 0, 0, 0, best.least
    while True:
        if v >= len(bound) or n >= BLOCK:
            if waiting:
                d = np.concatenate(waiting)
                best.add(item.scores(tf[d], m[d]), ids[d], known[d])
                least, scored, waiting, n = best.least, scored + n, [], 0
            if v >= len(bound):
                return scored
        if bound[v] < least:
            v = skip[v]
            continue
        if leaf[v] >= 0:
            d = tree.docs[tree.cut[leaf[v]]:tree.cut[leaf[v] + 1]]
            waiting.append(d)
            n += len(d)
        v += 1


class Shard:
    """Vectors of some documents, by term."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, m: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        order = np.argsort(term, kind="stable")
        self.ids, self.known, self.m = ids, known, m
        self.doc, self.count = doc[order], count[order]
        self.cut = np.searchsorted(term[order], np.arange(int(term.max(initial=-1)) + 2))

    def search(self, item: Item, best: Best) -> int:
        """Lay the item's vectors of these documents into trees and walk them."""
        scored = 0
        step = max(BEST, CELLS // max(1, len(item.terms)))
        for low in range(0, len(self.ids), step):
            high = min(low + step, len(self.ids))
            tf = np.zeros((high - low, len(item.terms)), np.int32)
            for k, t in enumerate(item.terms.tolist()):
                if t + 1 < len(self.cut):
                    a, b = self.cut[t], self.cut[t + 1]
                    a, b = a + np.searchsorted(self.doc[a:b], (low, high))
                    tf[self.doc[a:b] - low, k] = self.count[a:b]
            some = np.flatnonzero(tf.any(axis=1))
            if len(some):
                tf, m = tf[some], self.m[low + some]
                scored += walk(item, Tree(tf, m), tf, m, self.ids[low + some], self.known[low + some], best)
        return scored


def _shards(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int) -> Iterator[Shard]:
    """Shards of some ENTRIES entries; columns doc_id, n, terms, counts."""
    parts: list[tuple] = []

    def built() -> Shard:
        ids, known, n, size, term, count = (np.concatenate(x) for x in zip(*parts))
        return Shard(ids, known, 75 + (25 * n * n_docs) // n_terms, np.repeat(np.arange(len(ids)), size), term, count)

    held = 0
    for batch in batches:
        ids = batch.column(0)
        term = batch.column(2).flatten().to_numpy().astype(np.int64)
        parts.append((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), batch.column(1).to_numpy(),
                      batch.column(2).value_lengths().to_numpy(), term, batch.column(3).flatten().to_numpy().astype(np.int64)))
        held += len(term) + len(ids)
        if held >= ENTRIES:
            yield built()
            parts, held = [], 0
    if parts:
        yield built()


def _answers(rows: DataFrame, items: list[tuple[int, Item]], n_docs: int, n_terms: int) -> DataFrame:
    """(item, doc_id, score): the best of each partition for each item."""
    held = rows.sparkSession.sparkContext.broadcast((items, n_docs, n_terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, n_docs, n_terms = held.value
        best = {k: Best() for k, _ in items}
        small = (b.slice(at, 2048) for b in batches for at in range(0, b.num_rows, 2048))
        for shard in _shards(small, n_docs, n_terms):
            for k, item in items:
                if len(item.terms):
                    shard.search(item, best[k])
        pa.default_memory_pool().release_unused()
        for k, b in best.items():
            if len(b.scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(b.scores), k)), pa.array(b.ids, mask=~b.known), pa.array(b.scores)],
                    names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, doc_id long, score long")


def _slices(items: DataFrame) -> Iterator[list]:
    """The items with a text, some SLICE bytes at a time, in a fixed order."""
    rows = items.select("item_id", F.col("text").cast("binary").alias("text")).filter("text is not null").orderBy(
        F.col("item_id").asc_nulls_last(), "text").toLocalIterator()
    part, size = [], 0
    for r in rows:
        part.append((r.item_id, terms_of(bytes(r.text))))
        size += len(r.text)
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's BEST documents with a score above 0.

    Equal scores by ascending doc_id, rows with a null doc_id last; ranks are unique and
    begin at 1. Rows that repeat a doc_id are documents of their own, as are rows that
    repeat an item_id items of their own. Null texts, and texts without a term, match nothing
    and don't count in N. Other columns are ignored; with an empty table on either side
    there are no rows. Items go to the workers in slices of some SLICE bytes; each slice is
    one pass over the documents. The driver holds one slice's items and the numbers of
    documents that hold their terms. Between the passes of a slice lies a table of the restricted
    vectors; a task hands on at most BEST rows for each item.
    """
    spark = docs.sparkSession
    out, base = None, 0
    for part in _slices(items):
        number: dict[bytes, int] = {}
        numbered = [(item_id, [number.setdefault(t, len(number)) for t in ts]) for item_id, ts in part]
        rows = materialize(vectors(docs, number), "term-vectors")
        total = rows.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not total.docs:
            break
        df = {r.term: r.df for r in holders(rows).collect()}           # as many rows as the slice has terms
        weight = {t: math.floor(1000 * math.log((2 * total.docs + 2) / (2 * d + 1))) for t, d in df.items()}
        built = [(base + k, Item(ts, weight, df)) for k, (_, ts) in enumerate(numbered)]
        names = spark.createDataFrame([(base + k, i) for k, (i, _) in enumerate(numbered)], "item long, item_id long")
        base += len(part)
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        # Spark keeps the best rows of every task before they are shuffled, too
        top = _answers(rows, built, total.docs, total.terms).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= BEST)
        got = top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
