"""Toxicity by weak supervision.

Voters, each of which says "toxic" or stays silent: fixed and mined lexicons and
patterns. A generative label model takes the true label as hidden and estimates every
voter's accuracy by expectation maximisation; voters that remain correlated given the
label are joined into cliques whose joint votes are estimated instead. A linear
classifier over hashed words, word beginnings and votes is then trained on the posterior labels.
"""

from __future__ import annotations

import uuid
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import arrow_map
from .features import Adam, sample_labels

# Insults that the first voter knows.
LEXICON = """clown disgusting dumb garbage idiot idiots jerk loser losers moron morons pathetic scum stupid
trash ugly vermin worthless""".split()
MINED = 4               # voters over mined words
MINED_TERMS = 4000      # terms in all mined lexicons together, at most
LEAST_DOCS = 4          # toxic documents that a mined term is found in
PRECISION = 0.97
ROWS = 12_000           # labelled rows that mining looks at, at most
POSTERIOR_ROWS = 8000   # documents that the classifier is trained on, at most
VOTERS = 1 + MINED + 3 + 2
BITS = 13
WIDTH = 1 << BITS       # hashed words and beginnings share this many weights
EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_=+"


def terms_of(text: str | None) -> list[str]:
    """Lower-case words without punctuation at their edges."""
    return [x for w in (text or "").lower().split() if (x := w.strip(EDGES))]


def beginnings(term: str) -> tuple[str, ...]:
    """The term's first four, five and six letters, marked; empty where it is no longer than that."""
    return tuple("^" + term[:n] if len(term) > n else "" for n in (4, 5, 6))


def mine(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", rows: int = ROWS) -> list[str]:
    """Terms and beginnings that labelled documents show to be toxic, best first."""
    chosen = F.broadcast(sample_labels(labels, label, keep, rows))      # at most ``rows`` small rows

    def run(c):
        found = [{t for w in terms_of(x) for t in (w, *beginnings(w)) if t} for x in c["text"]]
        return {"label": c["label"], "terms": [sorted(f) for f in found]}

    picked = docs.select("doc_id", "text").join(chosen, "doc_id")
    counts = (
        arrow_map(picked, run, "label int, terms array<string>")
        .select("label", F.explode("terms").alias("term")).groupBy("term")
        .agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("all")))
    good = counts.filter((F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") >= PRECISION * F.col("all")))
    return [r.term for r in good.orderBy(F.desc("toxic"), "term").limit(MINED_TERMS).collect()]


class Reader:
    """Votes and hashed inputs of texts. Remembers words, at most LIMIT of them."""

    LIMIT = 300_000

    def __init__(self, mined: list[str]) -> None:
        import xxhash

        self.digest = xxhash.xxh3_64_intdigest
        self.masks: dict[str, int] = {}
        for t in mined:
            bit = 1 + self.digest(t) % MINED if t[0] != "^" else 1 + MINED + len(t) - 5
            self.masks[t] = self.masks.get(t, 0) | 1 << bit
        for t in LEXICON:
            self.masks[t] = self.masks.get(t, 0) | 1
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Vote mask, then four input positions of BITS bits each (0: none), in one number."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            mask, at, term = 0, [0] * 4, word.strip(EDGES)
            if term:
                for i, t in enumerate((term, *beginnings(term))):
                    if t:
                        mask |= self.masks.get(t, 0)
                        at[i] = 1 + VOTERS + self.digest(t) % (WIDTH - VOTERS - 1)
            got = self.known[word] = mask << 4 * BITS | at[0] << 3 * BITS | at[1] << 2 * BITS | at[2] << BITS | at[3]
        return got

    def _packed(self, text: str | None) -> tuple[int, np.ndarray]:
        """Votes, and the packed number of every word."""
        words = (text or "").lower().split()
        packed = np.fromiter(map(self.word, words), np.int64, len(words))
        marked = packed[packed >> 4 * BITS != 0]
        votes = int(np.bitwise_or.reduce(marked >> 4 * BITS)) if len(marked) else 0
        hits = len(marked)
        return votes | (hits >= 3) << VOTERS - 2 | (hits * 60 >= len(words) > 0) << VOTERS - 1, packed

    def votes(self, text: str | None) -> int:
        return self._packed(text)[0]

    def read(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
        """(votes, positions, values)."""
        votes, packed = self._packed(text)
        at = np.concatenate([packed >> i * BITS for i in range(4)]) & (WIDTH - 1)
        if len(at) > WIDTH // 4:
            counts = np.bincount(at, minlength=WIDTH)       # cheaper than a sort of many positions
            counts[0] = 0
            at = np.flatnonzero(counts)
            n = counts[at]
        else:
            at, n = np.unique(at[at > 0], return_counts=True)
        x = np.log1p(n)
        x = x / np.sqrt(x @ x) if len(x) else x
        # the votes themselves are inputs 1 to VOTERS
        cast = np.array([v + 1 for v in range(VOTERS) if votes >> v & 1], np.int64)
        return votes, np.concatenate([cast, at]), np.concatenate([np.ones(len(cast)), x])


def label_model(counts: dict[int, int], rounds: int = 60) -> np.ndarray:
    """P(toxic) for each of the 2^VOTERS vote patterns, from how often each occurs.

    The patterns are all that the model sees, so its size doesn't depend on the corpus.
    """
    votes = (np.arange(1 << VOTERS)[:, None] >> np.arange(VOTERS)) & 1
    n = np.zeros(len(votes))
    for k, v in counts.items():
        n[k] = v
    if not n.sum():
        return (votes.sum(1) > 0).astype(float)
    post = np.clip(votes.sum(1) / 3, 0.02, 0.98)           # start: the more voters, the likelier

    def em(post: np.ndarray, cliques: list[tuple[int, ...]]) -> np.ndarray:
        codes = [sum(votes[:, v] << i for i, v in enumerate(c)) for c in cliques]
        for _ in range(rounds):
            odds = np.zeros(len(votes))
            for y, weight in ((1, post * n), (0, (1 - post) * n)):
                sign = 1 if y else -1
                odds += sign * np.log(weight.sum() + 1)
                for code, c in zip(codes, cliques):
                    t = np.bincount(code, weights=weight, minlength=1 << len(c)) + 0.5
                    odds += sign * np.log(t / t.sum())[code]
            post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        return post

    alone = [(v,) for v in range(VOTERS)]
    post = em(post, alone)
    # correlation of two voters within the classes: joined if strong
    group = list(range(VOTERS))
    for a, b in combinations(range(VOTERS), 2):
        r = 0.0
        for weight in (post * n, (1 - post) * n):
            p = weight / max(weight.sum(), 1e-9)
            ma, mb = p @ votes[:, a], p @ votes[:, b]
            spread = np.sqrt(ma * (1 - ma) * mb * (1 - mb))
            r = max(r, abs(p @ (votes[:, a] * votes[:, b]) - ma * mb) / spread) if spread > 1e-6 else r
        size = sum(g in (group[a], group[b]) for g in group)
        if r > 0.3 and group[a] != group[b] and size <= 4:
            old = group[b]
            group = [group[a] if g == old else g for g in group]
    cliques = [tuple(v for v in range(VOTERS) if group[v] == g) for g in dict.fromkeys(group)]
    return em(post, cliques)


def fit_linear(rows: list[tuple], steps: int = 150) -> tuple[float, np.ndarray]:
    """Logistic regression on (posterior, positions, values) rows."""
    w, bias = np.zeros(WIDTH), 0.0
    if not rows:
        return bias, w
    y = np.array([r[0] for r in rows])
    size = np.array([len(r[1]) for r in rows])
    of = np.repeat(np.arange(len(rows)), size)
    at = np.concatenate([r[1] for r in rows]).astype(np.int64)
    x = np.concatenate([r[2] for r in rows])
    weight = y / max(1e-9, y.sum()) + (1 - y) / max(1e-9, (1 - y).sum())      # both classes weigh alike
    weight /= 2
    opt, opt_bias = Adam(w.shape, 0.2), Adam((), 0.1)
    for _ in range(steps):
        out = bias + np.bincount(of, weights=w[at] * x, minlength=len(rows))
        err = weight * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y)
        bias -= opt_bias.step(err.sum())
        w -= opt.step(np.bincount(at, weights=err[of] * x, minlength=WIDTH) + 2e-6 * w)
    return float(bias), w


_READERS: dict[str, Reader] = {}


def _share(spark, mined: list[str]):
    """The lexicon, at most MINED_TERMS terms, as a broadcast under a name of its own."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, mined))


def _reader(held) -> Reader:
    """One reader for each Python worker and lexicon."""
    name, mined = held.value
    if name not in _READERS:
        _READERS.clear()
        _READERS[name] = Reader(mined)
    return _READERS[name]


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic") -> tuple[list[str], float, np.ndarray]:
    """(mined terms, bias, weights), learnt from the documents whose key meets ``keep`` only.

    Labels are read for mining alone. Without labels the fixed lexicon votes by itself.
    """
    spark = docs.sparkSession
    mined = mine(docs, labels, keep, label)
    held = _share(spark, mined)

    def vote(c):
        return {"doc_id": c["doc_id"], "votes": [_reader(held).votes(t) for t in c["text"]]}

    own = docs.filter(keep & F.col("doc_id").isNotNull()).select("doc_id", "text")
    voted = materialize(arrow_map(own, vote, "doc_id long, votes int"), "toxic-votes")
    counts = {r.votes: r["count"] for r in voted.groupBy("votes").count().collect()}    # at most 2^VOTERS rows
    posterior = label_model(counts)
    # half of the training rows have votes, as far as there are such
    part = [voted.filter(c).groupBy("doc_id").agg(F.max("votes").alias("votes"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSTERIOR_ROWS // 2) for c in ("votes <> 0", "votes = 0")]
    chosen = F.broadcast(part[0].unionByName(part[1]))

    def read(c):
        got = [_reader(held).read(t) for t in c["text"]]
        return {"doc_id": c["doc_id"], "votes": c["votes"], "at": [g[1] for g in got], "x": [g[2] for g in got]}

    rows = arrow_map(own.join(chosen, "doc_id"), read, "doc_id long, votes int, at array<int>, x array<double>")
    table = rows.dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    bias, w = fit_linear([(posterior[v], np.array(a), np.array(x))
                          for v, a, x in zip(*(table[n].to_pylist() for n in ("votes", "at", "x")))])
    return mined, bias, w


def score_documents(docs: DataFrame, model: tuple[list[str], float, np.ndarray]) -> DataFrame:
    """(doc_id, score) for every row.

    A null or empty text has no inputs, so its score comes from the bias alone. Row by
    row: repeated rows get equal scores, an empty table gives none; further columns are
    never read.
    """
    mined, bias, w = model
    spark = docs.sparkSession
    held, weights = _share(spark, mined), spark.sparkContext.broadcast(w)

    def run(c):
        out = []
        for t in c["text"]:
            _, at, x = _reader(held).read(t)
            out.append(float(1 / (1 + np.exp(-np.clip(bias + weights.value[at] @ x, -30, 30)))))
        return {"doc_id": c["doc_id"], "score": out}

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, score double")
