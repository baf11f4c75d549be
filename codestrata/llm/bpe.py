"""Byte-pair encoding and decoding by a token automaton.

Compiling. The merges are taken one after another. Each is a gadget: it adds an arc
labelled with its new token, which runs over the path of its left part and then its
right part, and it forbids the left part from being followed by the right part from
then on. A gadget whose own path an earlier gadget has already cut gives a token that
no text can reach. Two arcs may follow each other exactly if no gadget fires across
the seam between them before one of the two merges that build their inner edges, so
the product table of states (last arc taken) and arcs is filled entry by entry from
the gadgets, on first use: whole, it would have 49,406 squared entries.

Running. Reading a pre-split word symbol by symbol, each prefix has exactly one
accepting path; its last arc is found by table look-ups alone. The labels along the
path are the tokens; decoding emits the labels of given ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map

END = "</w>"
CACHED = 120_000        # words whose path a worker remembers, twice over
SEAMS = 300_000         # filled entries of the product table that a worker remembers


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Automaton:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.labels = {i: s for s, i in [*self.ids.items(), *self.added.items()]}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}      # token: left, right, rank
        reachable = {i for s, i in self.ids.items() if len(s.removesuffix(END)) == 1}
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = self.ids[a], self.ids[b]
            self.rank[left, right] = k
            made = self.ids[a + b]
            if made in self.parts:
                continue
            self.parts[made] = left, right, k
            if left in reachable and right in reachable and not self._fires(left, right, k):
                reachable.add(made)
        # arcs by the text they run over; longest is the longest arc in symbols
        self.arcs = {s: i for s, i in self.ids.items() if i in reachable}
        self.longest = max(len(s.removesuffix(END)) for s in self.arcs)
        self.size = {i: len(s.removesuffix(END)) for s, i in self.arcs.items()}
        self.table: dict[int, bool] = {}
        names = "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))
        self.specials = regex.compile(f"({names})") if names else None
        self.words: dict[str, tuple[bytes, str]] = {}
        self.before: dict[str, tuple[bytes, str]] = {}
        self.symbols = dict(enumerate(byte_symbols()))

    def forget(self) -> None:
        """Drop what reading texts has filled in; the compiled gadgets and arcs stay."""
        for memory in (self.words, self.before, self.table, self._left, self._right):
            memory.clear()

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that stand at one edge of ``token`` while it grows, each with the rank that swallows it."""
        known = (self._left, self._right)[side]
        if token not in known:
            out, at, until = [], token, float("inf")
            while True:
                out.append((at, until))
                if at not in self.parts:
                    break
                until = self.parts[at][2]
                at = self.parts[at][side]
            known[token] = out
        return known[token]

    def _fires(self, left: int, right: int, before: float) -> bool:
        """Whether a gadget of a rank under ``before`` fires across the seam of two arcs."""
        rank = self.rank
        for x, gone_x in self._edge(left, 1):
            for y, gone_y in self._edge(right, 0):
                k = rank.get((x, y))
                # of two equal merges the left one goes first
                if k is not None and k < before and k < gone_x and k <= gone_y:
                    return True
        return False

    def _seam(self, left: int, right: int) -> bool:
        """Table entry: whether arc ``right`` may follow arc ``left``."""
        key = left << 20 | right
        got = self.table.get(key)
        if got is None:
            if len(self.table) >= SEAMS:
                self.table.clear()
            got = self.table[key] = not self._fires(left, right, float("inf"))
        return got

    def path(self, word: str) -> list[int]:
        """Arcs of the one accepted path over a word of byte symbols."""
        n, arcs, seam, longest = len(word), self.arcs, self._seam, self.longest
        whole = arcs.get(word + END)
        if whole is not None:
            return [whole]
        last = [-1] * (n + 1)
        for i in range(1, n + 1):
            tail = END if i == n else ""
            for start in range(max(0, i - longest), i):
                arc = arcs.get(word[start:i] + tail)
                if arc is not None and (start == 0 or seam(last[start], arc)):
                    last[i] = arc
                    break
        out, i = [], n
        while i:
            out.append(last[i])
            i -= self.size[last[i]]
        return out[::-1]

    def word(self, piece: str) -> tuple[bytes, str]:
        """Little-endian ids and joined labels of one pre-split piece."""
        got = self.words.get(piece)
        if got is None:
            got = self.before.get(piece)
            if got is None:
                ids = self.path(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.symbols))
                got = pack(f"<{len(ids)}I", *ids), self.decode(ids)
            # words in use survive as the older half is forgotten
            if len(self.words) >= CACHED:
                self.before, self.words = self.words, {}
            self.words[piece] = got
        return got

    def pieces(self, text: str) -> list[str]:
        # The file also has runs of blanks replaced by one; no piece holds a blank, so that changes nothing.
        if text.isascii():
            return _SPLIT_ASCII.findall(text.lower())
        # lower-casing goes letter by letter: a final capital sigma becomes an ordinary one
        return _SPLIT.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, text: str | None) -> tuple[bytes, str, int]:
        """Ids as bytes, decoded text and number of tokens of a whole text."""
        raw, labels = [], []
        parts = [text or ""] if self.specials is None else self.specials.split(text or "")
        for part in parts:
            if part in self.added:
                raw.append(pack("<I", self.added[part]))
                labels.append(part)
                continue
            for piece in self.pieces(part):
                got = self.words.get(piece) or self.word(piece)
                raw.append(got[0])
                labels.append(got[1])
        ids = b"".join(raw)
        return ids, " ".join(labels), len(ids) // 4

    def decode(self, ids) -> str:
        """The labels of ``ids``, joined by blanks, as the file names no decoder."""
        return " ".join(map(self.labels.__getitem__, ids))


# Fixed value: the file's pattern for pieces, and the same for lower-case ASCII.
_SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """Compiled once in each Python worker, from the file at ``path`` on its machine."""
    return Automaton(path)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, n_tokens, ids_sha256, decoded_sha256) for every row; a null text has no ids.

    Row by row, so nulls, repeated rows and empty tables need no rule of their own;
    further columns are ignored.
    """
    def run(c):
        got = [automaton(path).encode(t) for t in c["text"]]
        at = np.concatenate([[0], np.cumsum([g[2] for g in got])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(g[0] for g in got), np.int32)))
        return {"ids": ids} | _digested(c["doc_id"], got)

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(rows, run, "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string",
                     lambda: automaton(path).forget()).withColumnRenamed("doc_id", key)


def _digested(keys: list, got: list[tuple[bytes, str, int]]) -> dict:
    return {"doc_id": keys, "n_tokens": [g[2] for g in got],
            "ids_sha256": [hashlib.sha256(g[0]).hexdigest() for g in got],
            "decoded_sha256": [hashlib.sha256(g[1].encode("utf-8", "surrogatepass")).hexdigest() for g in got]}


def decode_ids(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the labels of every row's ids; null ids give an empty text."""
    def run(c):
        return {"doc_id": c["doc_id"], "text": [automaton(path).decode(i or []) for i in c["ids"]]}

    return arrow_map(encoded.select(F.col(key).alias("doc_id"), F.col(ids).alias("ids")), run,
                     "doc_id long, text string").withColumnRenamed("doc_id", key)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) for every row, without shipping the ids."""
    def run(c):
        return _digested(c["doc_id"], [automaton(path).encode(t) for t in c["text"]])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
                     lambda: automaton(path).forget()).withColumnRenamed("doc_id", key)
