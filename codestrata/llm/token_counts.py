"""Word-piece counts by a longest-match automaton.

The vocabulary is a trie. Every node knows its failure link, the node of the text that
is still open once greedy matching has had to close pieces, and how many pieces that
closes. So the number of greedy longest-match pieces of a word comes out of one walk,
linear in its length, and no piece is ever built.
"""

from __future__ import annotations

import json
from collections import deque
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from .bpe import END, byte_symbols
from .common import arrow_map, lower_words

CACHED = 200_000
BYTES = dict(enumerate(byte_symbols()))


class Matcher:
    """Greedy longest-match counter over the pieces in ``vocab``.

    Every single symbol of a word must itself be a piece, else the word counts as one
    unknown piece.
    """

    def __init__(self, vocab: list[str]) -> None:
        self.step: list[dict[str, int]] = [{}]
        self.ends = [False]
        for piece in vocab:
            at = 0
            for c in self.symbols(piece):
                nxt = self.step[at].get(c)
                if nxt is None:
                    nxt = self.step[at][c] = len(self.step)
                    self.step.append({})
                    self.ends.append(False)
                at = nxt
            self.ends[at] = at > 0
        n = len(self.step)
        # fail: where matching goes on once the open text no longer fits (-1: never); popped: pieces closed on the way
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self.step[u].items():
                if self.ends[v]:
                    self.fail[v], self.popped[v] = 0, 1
                else:
                    z, closed = self.fail[u], self.popped[u]
                    while z != -1 and c not in self.step[z]:
                        closed += self.popped[z]
                        z = self.fail[z]
                    if z != -1:
                        self.fail[v], self.popped[v] = self.step[z][c], closed
                queue.append(v)
        self.known: dict[bytes, int] = {}

    @staticmethod
    def symbols(piece: str) -> list[str]:
        """Characters, the word's end being one symbol with the last of them."""
        body = piece.removesuffix(END)
        out = list(body)
        if piece != body and out:
            out[-1] += END
        return out

    def count(self, word: str) -> int:
        at, closed = 0, 0
        for c in self.symbols(word):
            while c not in self.step[at]:
                if self.fail[at] == -1 or at == 0:
                    return 1
                closed += self.popped[at]
                at = self.fail[at]
            at = self.step[at][c]
        while at != 0:
            if self.fail[at] == -1:
                return 1
            closed += self.popped[at]
            at = self.fail[at]
        return closed

    def of(self, word: bytes) -> int:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= CACHED:
                self.known.clear()
            got = self.known[word] = self.count(word.decode("latin-1").translate(BYTES) + END)
        return got


@lru_cache(maxsize=2)
def matcher(path: str) -> Matcher:
    with open(path, encoding="utf-8") as f:
        return Matcher(list(json.load(f)["model"]["vocab"]))


def count_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_pieces) for every row: words parted at blanks, A-Z lower-cased.

    ``path`` names a vocabulary file whose pieces are byte symbols, those that close a
    word ending in ``</w>``. Null or empty text: no words and no pieces. Row by row, so
    repeated rows and empty tables need no rule; further columns are ignored.
    """
    def run(c):
        of, words = matcher(path).of, [lower_words(t) for t in c["text"]]
        return {"doc_id": c["doc_id"], "n_words": [len(w) for w in words], "n_pieces": [sum(map(of, w)) for w in words]}

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(rows, run, "doc_id long, n_words long, n_pieces long").withColumnRenamed("doc_id", key)
