"""Benchmark decontamination: edit distance by random-walk embedding and bit sampling.

A document holds an item if one of its substrings is within MAX_EDITS percent of the
item's length in edit distance, both in lower case with single blanks.

An item is cut into more pieces of a few letters than it may have edits. An edit harms one piece
at most, so a substring within the limit has a known number of them unharmed, each shifted
by no more than the edits; only where so many meet is a window laid over the document, which loses
none. The CGK walk maps each window and each item to strings of three times their length, on which a small
edit distance has become a small Hamming distance: it reads the text letter by letter, and
whether it moves on after a letter is settled by a random bit for that letter and step. Sampled
places of several walks are compared as hash keys; windows that share a key with their item
are verified by an exact search, and after them the rest, as keys may miss a window.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import STEP, arrow_map, raw

MAX_EDITS = 15          # percent of the item's length
PIECES = (6, 5, 3, 1)   # letters of a piece; an item has the longest that leave one unharmed, and SURE of the longest ones
SURE = 5                # longer pieces meet less often by chance, but fewer of them are left
WALKS = 8               # independent embeddings
TABLES = 12             # hash keys from each
BITS = 2                # sampled places in a key
SLICE = 8 << 20         # bytes of item text sent to the workers at a time
FILTER = 20             # bits of the piece filter
CHUNK = 1 << 17         # letters whose pieces are looked up and counted at a time, so that the counts stay in the processor's cache
ASKED = 4096            # windows that are walked at a time
STEPS = 4096            # steps of a walk up to which its random bits are kept
PAIRS = 1 << 36         # letters of texts by letters of items that are compared at a time, so that their hits fit in memory


@lru_cache(maxsize=2 * WALKS)
def moves_of(seed: int, width: int) -> np.ndarray:
    """Whether the walk moves on after a letter at a step. More steps begin with the same ones."""
    return np.random.default_rng(seed).integers(0, 2, (width, 256), np.uint8)


def walks(texts: list[bytes], seed: int, width: int) -> np.ndarray:
    """CGK embedding of each text, padded to ``width`` columns with zeros."""
    # steps are made for a power of two, so that few tables of them are ever kept, and those are small
    steps = 1 << max(width - 1, 1).bit_length()
    moves = (moves_of if steps <= STEPS else moves_of.__wrapped__)(seed, steps if steps <= STEPS else width)
    longest = max(map(len, texts), default=0)
    s = np.zeros((len(texts), longest + 1), np.uint8)
    for i, t in enumerate(texts):
        s[i, :len(t)] = np.frombuffer(t, np.uint8)
    at = np.arange(len(texts)) * (longest + 1)
    last, flat = at + longest, s.ravel()
    out = np.zeros((width, len(texts)), np.uint8)
    for j in range(width):
        c = flat[at]
        out[j] = c
        at += moves[j][c]
        np.minimum(at, last, out=at)
    return out


def places(items: list[bytes], seed: int) -> list[np.ndarray]:
    """For each item the sampled places of its walk: TABLES keys of BITS places."""
    rng = np.random.default_rng(seed + 1000)
    # a walk makes a step forward every other time, so two lengths of it have read the text
    share = rng.random((TABLES, BITS))
    return [(share * max(1, 2 * len(t))).astype(np.int64) for t in items]


def search(item: bytes, text: bytes, most: int) -> int:
    """Least edit distance of ``item`` to a substring of ``text``; most + 1 if it is greater.

    Bit-parallel: the column of the distance table is held as two whole numbers.
    """
    m = len(item)
    if not m:
        return 0
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << m - 1
    up, down, now, best = mask, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        level = (((eq & up) + up) ^ up) | eq | down
        grow = down | ~(level | up) & mask
        fall = up & level
        if grow & top:
            now += 1
        elif fall & top:
            now -= 1
        grow = grow << 1 & mask
        fall = fall << 1 & mask
        up = fall | ~(level | grow) & mask
        down = grow & level
        if now < best:
            best = now
    return min(best, most + 1)


def letters(buf: bytes, start: int, end: int, q: int) -> np.ndarray:
    """Each ``q`` letters from ``start`` to before ``end`` as one number; ``buf`` has eight bytes more."""
    return np.ndarray((end - start,), "<u8", buf, start, (1,)) & np.uint64((1 << 8 * q) - 1)


def spread_codes(codes: np.ndarray) -> np.ndarray:
    """Each code as another number, whose first FILTER bits are its place in the filter."""
    return codes * np.uint64(0x9E3779B97F4A7C15)


def filter_places(spread: np.ndarray) -> np.ndarray:
    return (spread >> np.uint64(64 - FILTER)).astype(np.int64)


class Items:
    """Pieces, sampled embeddings and texts of a bounded slice of items."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        texts = [(k, b" ".join(raw(t).lower().split())) for k, t in rows]
        texts = [(k, t) for k, t in texts if t]
        self.keys = [k for k, _ in texts]
        self.texts = [t for _, t in texts]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.most = [len(t) * MAX_EDITS // 100 for t in self.texts]
        self.width = max((2 * len(t) for t in self.texts), default=0) + 1
        self.pieces = []                    # by letters: filter, its first code, the most codes in a place of it, spread codes, where their entries are and how many
        q_of = [next(q for q in PIECES if len(t) // q - e >= (SURE if q == PIECES[0] else 1)) for t, e in zip(self.texts, self.most)]
        self.least = np.array([len(t) // q - e for t, e, q in zip(self.texts, self.most, q_of)], np.int64)
        self.of = self.off = np.zeros(0, np.int64)      # items and offsets of the pieces, an entry for each
        for q in sorted(set(q_of)):
            mine = [i for i, x in enumerate(q_of) if x == q]
            code = spread_codes(np.concatenate([letters(self.texts[i] + bytes(8), 0, len(self.texts[i]), q)[:len(self.texts[i]) // q * q:q] for i in mine]))
            n = np.array([len(self.texts[i]) // q for i in mine])
            of, off = np.repeat(mine, n), (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * q
            order = np.argsort(code, kind="stable")
            codes, first, n = np.unique(code[order], return_index=True, return_counts=True)
            held = np.bincount(filter_places(codes), minlength=1 << FILTER)
            self.pieces.append((q, held > 0, np.cumsum(held) - held, int(held.max()), codes, first + len(self.of), n))
            self.of, self.off = np.append(self.of, of[order]), np.append(self.off, off[order])
        # of each entry: what makes a place that of its item's end, bins a letter, a number of the item, pieces asked for
        self.after = (self.size[self.of] - self.off).astype(np.int32)
        self.rate = 1 / (np.array(self.most, np.float64)[self.of] + 1)
        self.salt = (self.of * 0x9E3779B1 & 0x7FFFFFFF).astype(np.int32)
        self.asks = np.minimum(self.least, np.iinfo(np.int32).max)[self.of].astype(np.int32)
        self.sampled = []
        for seed in range(WALKS):
            at = places(self.texts, seed)
            own = walks(self.texts, seed, self.width)
            self.sampled.append((np.array(at).reshape(-1, TABLES, BITS), np.array([own[p, i] for i, p in enumerate(at)]).reshape(-1, TABLES, BITS)))

    def hits(self, buf: bytes, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(place from ``start`` on, entry) wherever a piece of an item begins before ``end`` in ``buf``, which has eight more bytes."""
        places, entries = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for q, seen, begin, most, codes, first, many in self.pieces:
            got = spread_codes(letters(buf, start, end, q))
            of = filter_places(got)
            at = np.flatnonzero(seen[of])
            got, k = got[at], begin[of[at]]
            for _ in range(most):
                held = codes[k] == got
                place, which = at[held], k[held]
                n = many[which]
                entries.append(np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum()))
                places.append(np.repeat(place.astype(np.int32), n))
                if most > 1:
                    at, got, k = at[~held], got[~held], np.minimum(k[~held] + 1, len(codes) - 1)
        return np.concatenate(places), np.concatenate(entries)

    def crowded(self, buf: bytes, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Those hits from ``start`` to ``end`` beside which as many of their item may lie in line as a match has unharmed.

        Shifts of a match differ by its edits at most, so they are in one bin or in two side by side. Bins may
        share a count, which keeps more hits and never fewer.
        """
        place, entry = self.hits(buf, start, end)
        slots = 1 << max(10, (4 * len(place)).bit_length())
        line = place + self.after[entry]
        slot = ((line * self.rate[entry]).astype(np.int32) + self.salt[entry] & slots - 1) + 1
        count = np.bincount(slot, minlength=slots + 2).astype(np.int32)
        count[0], count[-1] = count[-2], count[1]
        pair = count[1:] + count[:-1]
        kept = np.flatnonzero(np.maximum(pair[1:], pair[:-1])[slot - 1] >= self.asks[entry])
        return place[kept] + np.int64(start), entry[kept]

    def windows(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, from, to): where as many pieces as a match has unharmed lie in line.

        start is where the pieces put the item's first letter; all substrings that the pieces may belong to lie from ``from`` to ``to``.
        """
        if not self.keys:
            return []
        ends = np.cumsum([len(t) + 1 for t in texts])
        begins = np.append(0, ends[:-1])
        # no piece holds the line end between two texts
        buf = b"\n".join(texts) + bytes(8)
        # hits are counted for whole texts, or parts of a text that share more than a match is long
        shared, found, start = 2 * int(self.size.max()) + 8, [], 0
        chunk = max(CHUNK, 4 * shared)
        while start < len(buf) - 8:
            end = min(start + chunk, len(buf) - 8)
            last = int(np.searchsorted(ends, end, "right"))
            whole = int(ends[last - 1]) if last and ends[last - 1] > start else None
            if end < len(buf) - 8 and whole:
                end = whole
            found.append(self.crowded(buf, start, end))
            start = end if end == whole or end == len(buf) - 8 else end - shared
        if not found:
            return []
        place, entry = (np.concatenate(x) for x in zip(*found))
        text = np.searchsorted(ends, place, "right")
        item, off = self.of[entry], self.off[entry]
        line = place - begins[text] - off
        # hits of a text and an item in order of their lines; what two parts share is there once
        room = int(max(map(len, texts), default=0) + 3 * self.size.max()) + 1
        key = (text * len(self.keys) + item) * room + line + self.size[item]
        order = np.lexsort((off, key)) if len(found) > 1 else np.argsort(key, kind="stable")
        key, off = key[order], off[order]
        once = np.append(np.ones(min(1, len(key)), bool), (key[1:] != key[:-1]) | (off[1:] != off[:-1]))
        key, off, order = key[once], off[once], order[once]
        line, item, text = line[order], item[order], text[order]
        edits = np.array(self.most, np.int64)[item]
        after = np.searchsorted(key, key + edits, "right")
        at = np.flatnonzero(after - np.arange(len(key)) >= self.least[item])
        if not len(at):
            return []
        # windows that share a hit are one
        new = np.append(True, at[1:] >= np.maximum.accumulate(after[at])[:-1])
        first, last = at[new], after[at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]]
        out = []
        for a, b in zip(first.tolist(), last.tolist()):
            i, e = int(item[a]), int(edits[a])
            if len(set(off[a:b].tolist())) >= self.least[i]:
                out.append((int(text[a]), i, int(line[(a + b) // 2]), max(0, int(line[a]) - e), max(0, int(line[b - 1]) + len(self.texts[i]) + e)))
        return out

    def near(self, asked: list[tuple[int, bytes]]) -> np.ndarray:
        """Whether each (item, window text) shares a key."""
        of = np.array([i for i, _ in asked], np.int64)
        hit = np.zeros(len(asked), bool)
        for seed, (at, own) in enumerate(self.sampled):
            todo = np.flatnonzero(~hit)
            if not len(todo):
                break
            width = int(at[of[todo]].max(initial=0)) + 1
            walked = walks([asked[i][1] for i in todo], seed, width)
            got = walked[at[of[todo]], np.arange(len(todo))[:, None, None]]
            hit[todo] = (got == own[of[todo]]).all(2).any(1)
        return hit

    def groups(self, data: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
        """(their texts, parts of texts) of bounded size; each substring that may match is whole in some part."""
        longest = int(self.size.max(initial=1))
        room = max(PAIRS // max(1, int(self.size.sum())), 4 * longest)
        of, group, size = [], [], 0
        for d, t in enumerate(data):
            for at in range(0, len(t), room):
                part = t[at:at + room + 2 * longest]
                if group and size + len(part) > room:
                    yield of, group
                    of, group, size = [], [], 0
                of.append(d)
                group.append(part)
                size += len(part)
        if group:
            yield of, group

    def matches(self, texts: list[str | None], every: bool = True) -> list[tuple[int, int, int]]:
        """(position of the text, item key, distance) for all items that the texts hold.

        Unless ``every`` counts, a text is done with the first item found in it.
        """
        data = [b" ".join(raw(t).lower().split()) for t in texts]
        best: dict[tuple[int, int], int] = {}
        done: set[int] = set()
        asked = []
        for of, group in self.groups(data):
            for g, i, at, start, end in self.windows(group):
                asked.append((of[g], i, group[g][max(0, at):max(0, at) + len(self.texts[i])], group[g], start, end))
                if len(asked) == ASKED:
                    self.verify(asked, best, done, every)
                    asked = []
        self.verify(asked, best, done, every)
        return [(d, self.keys[i], e) for (d, i), e in sorted(best.items()) if e <= self.most[i]]

    def verify(self, asked: list[tuple[int, int, bytes, bytes, int, int]], best: dict[tuple[int, int], int], done: set[int], every: bool) -> None:
        """Search the windows ``asked`` (text, item, window, part of the text, from, to); ``best`` and ``done`` take what is found."""
        near = self.near([(i, window) for _, i, window, _, _, _ in asked])
        # those that share a key first, then what the keys missed
        for k in np.argsort(~near, kind="stable").tolist():
            d, i, _, part, start, end = asked[k]
            far = best.get((d, i), self.most[i] + 1)
            if far and (every or d not in done):
                best[d, i] = min(far, search(self.texts[i], part[start:end], self.most[i]))
                if best[d, i] <= self.most[i]:
                    done.add(d)


_ITEMS: dict[str, Items] = {}


def _items(held) -> Items:
    name, rows = held.value
    if name not in _ITEMS:
        _ITEMS.clear()
        _ITEMS[name] = Items(rows)
    return _ITEMS[name]


def _slices(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """Broadcast slices of the items, of at most SLICE bytes each; a single longer item is a slice."""
    items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null").dropDuplicates()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, ceil(2 * total / SLICE))            # hashed slices are even to a factor well under two
    for k in range(slices):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k).orderBy("item_id", "text").collect()
        yield docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r.item_id, r.text) for r in rows]))


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance): every item that a document holds, with its least distance.

    Row by row and without a shuffle. Items are sent to the workers in slices of at most
    SLICE bytes (a single longer item is a slice); more items mean more passes. Null or
    empty texts and items hold and are held by nothing; a repeated item is reported once
    for each item_id, a repeated document once for each of its rows. Further columns are
    ignored.
    """
    out = None
    for held in _slices(docs, benchmark):
        def run(c, held=held):
            got = _items(held).matches(c["text"])
            return {"doc_id": [c["doc_id"][d] for d, _, _ in got], "item_id": [i for _, i, _ in got],
                    "distance": [e for _, _, e in got]}

        found = arrow_map(docs.select("doc_id", "text"), run, "doc_id long, item_id long, distance int")
        out = found if out is None else out.unionByName(found)
    return out


def _clean(held):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        out = np.ones(len(texts), bool)
        for at in range(0, len(texts), STEP):
            out[[at + d for d, _, _ in _items(held).matches(texts.iloc[at:at + STEP].tolist(), every=False)]] = False
        return pd.Series(out)

    return clean


def without_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, less the rows whose text holds an item.

    Each row is judged by its own text, whatever its doc_id, without a shuffle.
    """
    for held in _slices(docs, benchmark):
        docs = docs.filter(_clean(held)("text"))
    return docs
