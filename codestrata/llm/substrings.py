"""Substring dedup by FM-indexes.

A run of WINDOW words goes if it also starts in a document with a smaller doc_id.

Which runs can be shared at all is found first: every run has an anchor, the run of GRAM
words inside it with the least hash, so equal runs have equal anchors. Only anchors that
occur in two different texts matter. Around each of these the words of its runs are cut
out as one segment; equal segments become one, under the least doc_id that has it, and
the segments are dealt to shards by anchor. A shard holds an FM-index of its segments: a
suffix order, the wavelet matrix of its Burrows-Wheeler transform and common prefix
lengths. Segments stream through it from right to left; a backward step takes one more
word to the left, and where WINDOW words are matched, the longest common prefixes widen
the interval to WINDOW - 1 words before the next step. The least doc_id within the
interval settles the run.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialize
from .common import arrow_map, bit_filter, hash_texts, holds, raw, shingle_hashes, words_of

WINDOW = 13
GRAM = 4
UNIT = 400_000          # words that an index holds; only more words of one anchor make it larger


class FmIndex:
    """FM-index of a symbol array, for patterns of at most 16 symbols.

    Symbol 0 ends a segment and is no part of any pattern.
    """

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        n = self.n = len(text)
        rank, k = text.astype(np.int64), 1
        # suffixes in the order of their first 16 symbols, by doubling
        while k <= 16:
            order = np.argsort(rank, kind="stable")
            if k == 16:
                break
            after = np.zeros(n, np.int64)
            after[:n - k] = rank[k:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + after
            _, rank = np.unique(key, return_inverse=True)
            k *= 2
        self.order = order
        bwt = text[order - 1]                               # the text ends in 0, which stands before its start
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.levels = []                                    # (packed bits, ones before each word, zeros)
        for bit in reversed(range(max(1, int(sigma - 1).bit_length()))):
            ones = (bwt >> bit & 1).astype(bool)
            padded = np.zeros(-(-(n + 1) // 64) * 64, bool)
            padded[:n] = ones
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed))[:-1]]).astype(np.int64)
            self.levels.append((bit, packed, before, n - int(ones.sum())))
            bwt = np.concatenate([bwt[~ones], bwt[ones]])
        every = np.arange(sigma)
        self.start = self._descend(every, np.zeros(sigma, np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, packed, before, zeros in self.levels:
            word = i >> 6
            low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(packed[word] & low)
            i = np.where(c >> bit & 1, zeros + ones, i - ones)
        return i

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after taking symbol ``c`` to the left of the patterns of [lo, hi)."""
        base = self.first[c] - self.start[c]
        return base + self._descend(c, lo), base + self._descend(c, hi)

    def blocks(self, text: np.ndarray, depth: int) -> np.ndarray:
        """For each suffix in order whether it differs from the one before in its first ``depth`` symbols."""
        padded = np.concatenate([text, np.zeros(depth, text.dtype)])
        new = np.ones(self.n, bool)
        new[1:] = False
        for d in range(depth):
            s = padded[self.order + d]
            new[1:] |= s[1:] != s[:-1]
        return new


def window_minima(segments: list[list[str]], docs: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For every window of every segment the least of ``docs`` among the segments that contain it."""
    sizes = np.array([len(s) for s in segments], np.int64)
    known: dict[str, int] = {}
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    ends = np.cumsum(sizes + 1) - 1                         # place of each segment's closing 0
    flat = [known.setdefault(w, len(known) + 1) for s in segments for w in s]
    inner = np.ones(len(text), bool)
    inner[ends] = False
    text[inner] = flat
    fm = FmIndex(text, len(known) + 1)
    owner = np.repeat(np.asarray(docs, np.int64), sizes + 1)[fm.order]

    def spans(depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.flatnonzero(fm.blocks(text, depth))
        of = np.zeros(fm.n, np.int64)
        of[starts] = 1
        return np.cumsum(of) - 1, starts, np.append(starts[1:], fm.n)

    of_short, short_lo, short_hi = spans(window - 1)
    of_full, full_lo, _ = spans(window)
    least = np.minimum.reduceat(owner, full_lo)

    count = sizes - window + 1
    out = np.zeros((len(segments), int(count.max(initial=0))), np.int64)
    # the last window of each segment: plain backward search
    c = text[ends - 1]
    lo, hi = fm.first[c], fm.first[c + 1]
    for k in range(2, window + 1):
        lo, hi = fm.step(text[ends - k], lo, hi)
    at = count - 1
    rows = np.arange(len(segments))
    while len(rows):
        out[rows, at[rows]] = least[of_full[lo]]
        go = at[rows] > 0
        rows, lo = rows[go], lo[go]
        if not len(rows):
            break
        at[rows] -= 1
        block = of_short[lo]
        lo, _ = fm.step(text[ends[rows] - sizes[rows] + at[rows]], short_lo[block], short_hi[block])
    return [out[i, :n] for i, n in enumerate(count)]


def anchors(h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each stretch of windows with the same anchor."""
    n = len(h) - window + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none
    grams = shingle_hashes(h, GRAM)
    inside = np.lib.stride_tricks.sliding_window_view(grams, window - GRAM + 1)
    place = inside.argmin(1) + np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return grams[place[first]], first, np.append(first[1:], n) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with _doc, a hash of doc_id and text, which names a text of a document."""
    return docs.withColumn("_doc", F.xxhash64("doc_id", F.xxhash64("text")))


def occurrences(docs: DataFrame, maybe=None) -> DataFrame:
    """(anchor, h, doc, span): anchors of every text with the windows they cover.

    span is the first window times 16 and the number of further ones. ``maybe``: a
    broadcast filter; anchors that it rules out are left out.
    """
    def run(c):
        out = {"h": c["h"], "doc": c["doc"], "anchor": [], "span": []}
        for h in hash_texts([raw(t) for t in c["text"]]):
            anchor, first, last = anchors(h)
            span = first * 16 + last - first
            if maybe is not None:
                ok = holds(maybe.value, anchor)
                anchor, span = anchor[ok], span[ok]
            out["anchor"].append(anchor)
            out["span"].append(span)
        return out

    rows = docs.filter("doc_id is not null").select(
        "text", F.xxhash64("text").alias("h"), F.xxhash64("doc_id", F.xxhash64("text")).alias("doc"))
    got = arrow_map(rows, run, "h long, doc long, anchor array<long>, span array<long>")
    return got.select("h", "doc", F.explode(F.arrays_zip("anchor", "span")).alias("z")).select("h", "doc", "z.anchor", "z.span")


def _index_shard(table: pa.Table) -> pa.Table:
    """Windows' least doc_ids of all segments of a shard, index by index."""
    table = table.group_by(["anchor", "seg"]).aggregate([("doc", "min")]).sort_by([("anchor", "ascending"), ("seg", "ascending")])
    anchor, docs, texts = table["anchor"].to_numpy(), table["doc_min"].to_numpy(), table["seg"].to_pylist()
    segments = [t.split(" ") for t in texts]
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else []
    total = np.cumsum([0, *map(len, segments)])
    mins, begin = [], 0
    for k, s in enumerate(starts):
        end = starts[k + 1] if k + 1 < len(starts) else len(segments)
        if total[end] - total[begin] >= UNIT or end == len(segments):
            mins += window_minima(segments[begin:end], docs[begin:end])
            begin = end
    return pa.table({"seg_key": pa.array(map(_seg_key, texts), pa.binary()), "mins": pa.array(mins, pa.list_(pa.int64()))})


def _seg_key(seg: str) -> bytes:
    return xxhash.xxh3_128_digest(seg.encode("utf-8", "surrogatepass"))


def _segments(words: list[bytes], spans: list[dict]):
    for s in spans:
        first, more = divmod(s["span"], 16)
        yield s["anchor"], first, b" ".join(words[first:first + more + WINDOW]).decode("utf-8", "surrogatepass")


def _cut_for_index(c: dict) -> dict:
    """Segments of a few texts, each once, under the least doc_id among them."""
    least: dict[tuple[int, str], int] = {}
    for key, text, spans in zip(c["doc_id"], c["text"], c["spans"]):
        for anchor, _, seg in _segments(words_of(text), spans):
            least[anchor, seg] = min(key, least.get((anchor, seg), key))
    return {"anchor": [a for a, _ in least], "seg": [s for _, s in least], "doc": list(least.values())}


def _cut_for_answers(c: dict) -> dict:
    out = {k: [] for k in ("doc", "doc_id", "first", "seg_key")}
    for doc, key, text, spans in zip(c["_doc"], c["doc_id"], c["text"], c["spans"]):
        for _, first, seg in _segments(words_of(text), spans):
            for k, v in zip(out, (doc, key, first, _seg_key(seg))):
                out[k].append(v)
    return out


def repeated_windows(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(_doc, _starts): windows of every text that a smaller doc_id has too.

    ``texts`` is keyed(docs) without null doc_ids. Texts that wholly equal an earlier
    document's are left out (see first_holders). Rows of one doc_id never count against
    each other.
    """
    spark = docs.sparkSession
    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = materialize(occurrences(docs).groupBy("anchor").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
                         .filter("lo <> hi").select("anchor"), "shared-anchors")
    maybe = spark.sparkContext.broadcast(bit_filter(shared, "anchor"))
    leads = first_holders(docs).filter("doc_id = first_id").select("_doc").distinct()
    spans = (
        occurrences(docs, maybe).select("anchor", "doc", "span").join(shared, "anchor").groupBy(F.col("doc").alias("_doc"))
        .agg(F.collect_list(F.struct("anchor", "span")).alias("spans"))         # no longer than the text
        .join(leads, "_doc", "left_semi"))
    chosen = texts.join(spans, "_doc").select("_doc", "doc_id", "text", "spans")
    minima = (
        arrow_map(chosen, _cut_for_index, "anchor long, seg string, doc long")
        .withColumn("shard", F.pmod("anchor", F.lit(shards))).groupBy("shard")
        .applyInArrow(_index_shard, "seg_key binary, mins array<long>"))
    asked = arrow_map(chosen, _cut_for_answers, "doc long, doc_id long, first int, seg_key binary")
    starts = F.expr("filter(transform(mins, (m, i) -> if(m < doc_id, first + i, -1)), x -> x >= 0)")
    return (
        asked.join(minima, "seg_key").select(F.col("doc").alias("_doc"), starts.alias("starts")).filter("size(starts) > 0")
        .groupBy("_doc").agg(F.flatten(F.collect_list("starts")).alias("_starts")))         # no longer than the text


def first_holders(docs: DataFrame) -> DataFrame:
    """(doc_id, _doc, first_id) with the least doc_id that has the very same text."""
    rows = keyed(docs.filter("doc_id is not null")).select("doc_id", "_doc", F.unhex(F.md5("text")).alias("digest"))
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    return rows.join(least, "digest").select("doc_id", "_doc", "first_id")


_KEPT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                      T.StructField("kept", T.StringType())])


@F.pandas_udf(_KEPT)
def _keep(text: pd.Series, copy: pd.Series, starts: pd.Series) -> pd.DataFrame:
    out = []
    for t, c, s in zip(text, copy, starts):
        words = words_of(t)
        gone = np.zeros(len(words), bool)
        if c is True and len(words) >= WINDOW:
            gone[:] = True
        elif s is not None and len(s):
            edge = np.zeros(len(words) + 1, np.int32)
            np.add.at(edge, s, 1)
            np.add.at(edge, np.asarray(s) + WINDOW, -1)
            gone = np.cumsum(edge[:-1]) > 0
        kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
        out.append((len(words), int(gone.sum()), kept.decode("utf-8", "surrogatepass")))
    return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])


def dedup(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with a struct dedup of n_words, n_removed and kept.

    kept: the words that stay, joined by one blank. Null text: no words. A text with
    fewer than WINDOW words has no window and stays. Rows with a null doc_id stay and
    remove nothing; rows of one doc_id are one document as far as "smaller" goes, so they
    don't remove each other's words. Empty table: no rows. A column of ``docs`` that is
    itself named dedup is replaced.
    """
    copies = first_holders(docs).filter("first_id < doc_id").select("_doc", F.lit(True).alias("_copy")).distinct()
    # both joins with the texts ask for the same rows in the same order, so they are shuffled once
    texts = keyed(docs.filter("doc_id is not null"))
    rows = texts.join(repeated_windows(docs, texts), "_doc", "left").join(copies, "_doc", "left")
    alone = docs.filter("doc_id is null").withColumns(
        {"_copy": F.lit(False), "_starts": F.lit(None).cast("array<int>")})
    rows = rows.select(*docs.columns, "_copy", "_starts").unionByName(alone)
    return rows.withColumn("dedup", _keep("text", F.coalesce("_copy", F.lit(False)), "_starts")).drop("_copy", "_starts")


def digests(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).select(
        "doc_id", "dedup.n_words", "dedup.n_removed", F.sha2("dedup.kept", 256).alias("kept_sha256"))
