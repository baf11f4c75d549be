"""Runs: stretches of words with a period, found through longest common extensions.

A run is a stretch of consecutive words that keeps a period q (words q apart are identical),
can't be extended on either side, and is at least LEAST words and THRICE periods long.

* Difference cover. Of each V positions four are sampled, such that any two positions reach
  sampled ones after the same few steps. Only the suffixes at sampled positions are sorted,
  by prefix doubling over blocks of V words.
* The longest common extension of two positions compares words one by one until both are
  sampled, and ends there in most cases; otherwise the least value between their ranks, from
  a sparse table over the neighbours' common lengths, gives the rest.
* Harmonic grid. A run of period p matches itself p words on over at least
  max(LEAST - p, (THRICE - 1) p) words. For every p grid points are laid half of that apart, so two
  neighbouring ones lie inside; where both have matching words, extensions to both sides
  from the first give the run's exact ends. Of equal stretches the least period counts.

The texts of a batch are handled together by array operations. Only texts where some grid
point gets past the first comparison of words have their suffixes sorted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map

LEAST = 24              # words a run has at least
THRICE = 3              # periods a run has at least
V = 13
COVER = (0, 1, 3, 9)    # every difference modulo V is one of two of these
PAIRS = 1 << 20         # grid points handled at a time
WORDS = 1 << 18         # words of texts handled together; a longer text is handled alone

_IN = np.zeros(V, bool)
_IN[list(COVER)] = True
# steps from positions r and r + d (modulo V) until both are sampled
_STEPS = np.array([[min(s for s in range(V) if _IN[(r + s) % V] and _IN[(r + d + s) % V]) for d in range(V)]
                   for r in range(V)], np.int64)


class Extensions:
    """Common extensions to the right within texts laid one after another.

    ``words`` holds the texts' word numbers with one -1 behind each text; ``starts`` and
    ``ends`` are the places of each text's first word and of its -1.
    """

    def __init__(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self.words = words
        sizes = ends - starts + 1
        self.first = np.repeat(starts, sizes)       # of each place, where its text begins
        self.last = np.repeat(ends, sizes)
        self.table: list[np.ndarray] | None = None

    def _sort(self) -> None:
        """Ranks of the sampled suffixes and the sparse table over their common lengths."""
        words, last = self.words, self.last
        place = np.arange(len(words))
        at = place[_IN[(place - self.first) % V] & (place < last)]
        number = np.zeros(len(words), np.int64)
        number[at] = np.arange(len(at))
        block = words[np.minimum(at[:, None] + np.arange(V), last[at][:, None])]
        order = np.lexsort([*block.T[::-1], self.first[at]])
        text, sorted_block = self.first[at][order], block[order]
        new = np.ones(len(at), bool)
        new[1:] = (text[1:] != text[:-1]) | (sorted_block[1:] != sorted_block[:-1]).any(axis=1)
        rank = np.empty(len(at), np.int64)
        rank[order] = np.cumsum(new)
        levels, step = [rank], V
        while levels[-1].max(initial=0) < len(at):
            onward = self._rank_at(levels[-1], number, at, step)
            _, inverse = np.unique(levels[-1] * (len(at) + 1) + onward, return_inverse=True)
            levels.append(inverse + 1)
            step *= 2
        self.rank, self.number = levels[-1] - 1, number
        order = np.argsort(self.rank)
        a, b = at[order[:-1]], at[order[1:]]
        common = np.zeros(len(a), np.int64)
        inside = self.first[a] == self.first[b]
        step = V << (len(levels) - 1)
        for level in levels[::-1]:
            same = inside & (self._rank_at(level, number, a, common) == self._rank_at(level, number, b, common))
            common[same] += step
            step //= 2
        self.table = [self._finish(a, b, common, inside)]
        width = 1
        while 2 * width <= len(common):
            low = self.table[-1]
            self.table.append(np.minimum(low[:-width], low[width:]))
            width *= 2

    def _rank_at(self, level: np.ndarray, number: np.ndarray, at: np.ndarray, on) -> np.ndarray:
        """Rank at the places ``on`` words further; 0 behind a text's end."""
        to = at + on
        beyond = to >= self.last[at]
        return np.where(beyond, 0, level[number[np.where(beyond, at, to)]])

    def _finish(self, a: np.ndarray, b: np.ndarray, common: np.ndarray, going: np.ndarray) -> np.ndarray:
        """Words behind the last whole block that are still equal."""
        going, out = going.copy(), common.copy()
        for _ in range(V):
            left, right = self.words[np.minimum(a + out, self.last[a])], self.words[np.minimum(b + out, self.last[b])]
            going &= (left == right) & (left >= 0)
            if not going.any():
                break
            out[going] += 1
        return out.astype(np.int32)

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words from i and j on before both are sampled, and whether more may follow."""
        out = np.zeros(len(i), np.int64)
        steps = _STEPS[(i - self.first[i]) % V, (j - i) % V]
        going, open_ = np.arange(len(i)), np.ones(len(i), bool)
        for t in range(V):
            going = going[steps[going] > t]
            if not len(going):
                break
            same = self.words[i[going] + t] == self.words[j[going] + t]
            open_[going[~same]] = False
            going = going[same]
            out[going] += 1
        return out, open_ & (j + out < self.last[j])

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from i and j on, i < j being places of one text."""
        out, open_ = self.near(i, j)
        far = np.flatnonzero(open_)
        if len(far):
            if self.table is None:
                self._sort()
            lo, hi = self.rank[self.number[i[far] + out[far]]], self.rank[self.number[j[far] + out[far]]]
            lo, hi = np.minimum(lo, hi), np.maximum(lo, hi)
            level = np.frexp((hi - lo).astype(np.float64))[1] - 1
            for k in np.unique(level):
                row, of = self.table[k], level == k
                out[far[of]] += np.minimum(row[lo[of]], row[hi[of] - (1 << int(k))])
        return out


def _grid(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """(text, place, period, step) of grid points with equal words p apart, also at the point after them."""
    periods = sizes // THRICE
    text = np.repeat(np.arange(len(sizes)), periods)
    p = np.arange(1, len(text) + 1) - np.repeat(np.cumsum(periods) - periods, periods)
    step = np.maximum(LEAST - p, (THRICE - 1) * p) // 2
    points = np.maximum((sizes[text] - p - 1) // step, 0)       # the last one has a point after it
    bounds = np.cumsum(points)
    at = 0
    while at < len(points):
        end = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + PAIRS, "right")))
        n = points[at:end]
        row = np.repeat(np.arange(at, end), n)
        i = starts[text[row]] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * step[row]
        hit = words[i] == words[i + p[row]]
        row, i = row[hit], i[hit]
        hit = words[i + step[row]] == words[i + step[row] + p[row]]
        row, i = row[hit], i[hit]
        if len(row):
            yield text[row], i, p[row], step[row]
        at = end


def _lay(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    words = np.full(int(sizes.sum()) + len(texts), -1, np.int64)
    for s, t in zip(starts, texts):
        words[s:s + len(t)] = t
    return words, starts, sizes


def _mirrored(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    back = words.copy()
    for s, e in zip(starts, ends):
        back[s:e] = words[s:e][::-1]
    return back


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period), each stretch with its least period only."""
    rows = rows[np.lexsort([rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    return rows[new]


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text of word numbers its runs as rows (start, length, period), by start, then period."""
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    chosen = np.array([k for k, t in enumerate(texts) if len(t) >= LEAST], np.int64)
    if len(chosen):
        words, starts, sizes = _lay([texts[k] for k in chosen])
        near = Extensions(words, starts, starts + sizes)
        hit = np.zeros(len(chosen), bool)
        for text, i, p, step in _grid(words, starts, sizes):
            equal, open_ = near.near(i, i + p)
            hit[text[open_ | (equal > step)]] = True
        chosen = chosen[hit]
    if not len(chosen):
        return out
    words, starts, sizes = _lay([texts[k] for k in chosen])
    ends = starts + sizes
    right, left = Extensions(words, starts, ends), Extensions(_mirrored(words, starts, ends), starts, ends)
    found = np.zeros((0, 4), np.int64)
    for text, i, p, step in _grid(words, starts, sizes):
        after = right.of(i, i + p)
        keep = after > step
        text, i, p, after = text[keep], i[keep], p[keep], after[keep]
        before = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > starts[text])
        mirror = (starts + ends - 1)[text[inner]]
        before[inner] = left.of(mirror - (i[inner] + p[inner] - 1), mirror - (i[inner] - 1))
        length = before + after + p
        keep = (length >= LEAST) & (length >= THRICE * p)
        rows = np.stack([text, i - before - starts[text], length, p], axis=1)[keep]
        found = _distinct(np.concatenate([found, _distinct(rows)]))
    found = found[np.lexsort([found[:, 3], found[:, 1], found[:, 0]])]
    cut = np.searchsorted(found[:, 0], np.arange(len(chosen) + 1))
    for k, a, b in zip(chosen, cut[:-1], cut[1:]):
        out[k] = found[a:b, 1:]
    return out


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def _numbered(texts: list[list[bytes]]) -> list[np.ndarray]:
    number = {w: k for k, w in enumerate(set().union(*texts))}
    return [np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in texts]


def _find(c: dict) -> dict:
    out = {"row_key": c["row_key"], "n_words": [], "starts": [], "lengths": [], "periods": [], "collapsed": []}
    every = [(t or b"").split() for t in c["text"]]
    at = 0
    while at < len(every):
        end, size = at + 1, len(every[at])
        while end < len(every) and size + len(every[end]) <= WORDS:
            size += len(every[end])
            end += 1
        group = every[at:end]
        for ws, runs in zip(group, runs_of(_numbered(group))):
            if len(runs):
                ws_left = [w for w, k in zip(ws, _kept(len(ws), runs).tolist()) if k]
            else:
                ws_left = ws
            out["n_words"].append(len(ws))
            for name, column in zip(("starts", "lengths", "periods"), runs.T):
                out[name].append(column.tolist())
            out["collapsed"].append(b" ".join(ws_left).decode("utf-8", "surrogatepass"))
        at = end
    return out


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs``.

    runs: array of structs (start, length, period) by start, then period, words counted from
    0. collapsed: the words that stay, joined by one blank, when of each run all behind its
    first period goes. Null, empty and blank texts have no words, no runs and an empty
    ``collapsed``. Null and repeated doc_ids are kept, each row being a document of its own.
    Columns other than doc_id and text are ignored. Empty table: no rows. Row by row and
    without a shuffle; a very long text is held whole by one task, at some 250 bytes a word.
    """
    got = arrow_map(docs.select(F.col("doc_id").alias("row_key"), F.col("text").cast("binary").alias("text")), _find,
                    "row_key long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string")
    runs = F.zip_with(F.arrays_zip("starts", "lengths"), "periods",
                      lambda a, q: F.struct(a["starts"].alias("start"), a["lengths"].alias("length"), q.alias("period")))
    return got.select(F.col("row_key").alias("doc_id"), "n_words", runs.alias("runs"), "collapsed")


def _stronger(a, b):
    """Whether run a comes before b: greater length / period, then smaller start, then smaller period."""
    x, y = a["length"] * b["period"], b["length"] * a["period"]
    return (x > y) | ((x == y) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))


def digests(found: DataFrame) -> DataFrame:
    """Of find_runs' rows: number of runs, the strongest one (nulls without a run) and digests."""
    best = F.reduce("runs", F.element_at(F.col("runs"), F.lit(1)), lambda a, r: F.when(_stronger(r, a), r).otherwise(a))
    best = F.when(F.size("runs") > 0, best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


BLANK = r"[ \t-\r]+"


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by crc32 of its doc_id, made periodic from some word on.

    With h the crc32 and g = h div 10: of n words those from a = g mod n on repeat with period
    1 + (n - a) div (3 + g mod 8). Others, and rows with a null doc_id, are left as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", BLANK), lambda w: w != "")

    def planted(ws):
        n = F.size(ws)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(ws, i)), " ")).otherwise("")

    changed = F.transform(F.array(words), planted)[0]
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, changed).otherwise(F.col("text")).alias("text"))
