"""Quality classifier: a factorisation machine.

Inputs are hashed words, structure statistics and the recorded length. Pairwise
interactions have rank RANK and are scored in linear time: for each factor half of
the square of the sum less the sum of the squares.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_map, hash_texts, raw
from .features import STRUCTURE, Adam, sample_labels, structure

BUCKETS = 2048          # word hashes
RANK = 6
ROWS = 3000             # labelled rows that training looks at, at most
EPOCHS = 120
WIDTH = BUCKETS + STRUCTURE


def inputs(texts: list[str | None], lengths: list[int | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, values) of documents; words share a length of one."""
    data, out = [raw(t) for t in texts], []
    for text, d, h, n_chars in zip(texts, data, hash_texts([d.lower() for d in data]), lengths):
        stats = structure(d, h, len(text or "") if n_chars is None else n_chars)
        counts = np.bincount(h & (BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        v = np.log1p(counts[at])
        if len(at):
            v /= np.sqrt(v @ v)
        out.append((np.concatenate([at, BUCKETS + np.arange(STRUCTURE)]), np.concatenate([v, stats])))
    return out


def score(model: tuple, at: np.ndarray, x: np.ndarray) -> float:
    bias, w, v = model
    f = v[at] * x[:, None]
    s = f.sum(0)
    y = bias + w[at] @ x + 0.5 * (s @ s - (f * f).sum())
    return float(1 / (1 + np.exp(-np.clip(y, -30, 30))))


def fit(rows: list[tuple], seed: int = 7) -> tuple:
    """Train on (label, positions, values) rows; without rows every score is 0.5."""
    rng = np.random.default_rng(seed)
    bias, w, v = 0.0, np.zeros(WIDTH), rng.normal(0, 0.05, (WIDTH, RANK))
    if not rows:
        return bias, w, np.zeros_like(v)
    x = np.zeros((len(rows), WIDTH), np.float32)
    for i, (_, at, val) in enumerate(rows):
        x[i, at] = val
    y = np.array([r[0] for r in rows], np.float64)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))   # both labels weigh alike
    xx, opt = x * x, [Adam((), 0.05), Adam(w.shape, 0.05), Adam(v.shape, 0.02)]
    for _ in range(EPOCHS):
        v32 = v.astype(np.float32)
        s = x @ v32
        out = bias + x @ w.astype(np.float32) + 0.5 * ((s * s).sum(1) - xx @ (v32 * v32).sum(1))
        err = (weight * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y)).astype(np.float32)
        bias -= opt[0].step(err.sum())
        w -= opt[1].step(x.T @ err + 1e-5 * w)
        v -= opt[2].step(x.T @ (err[:, None] * s) - v * (xx.T @ err)[:, None] + 1e-5 * v)
    return float(bias), w, v


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", rows: int = ROWS) -> tuple:
    """Fit on at most ``rows`` labelled documents whose key meets ``keep``."""
    chosen = sample_labels(labels, label, keep, rows)

    def run(c):
        got = inputs(c["text"], c["n_chars"])
        return {"doc_id": c["doc_id"], "label": c["label"], "at": [g[0] for g in got], "x": [g[1] for g in got]}

    # at most ``rows`` small rows, so its size is bounded whatever the input
    picked = docs.select("doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id")
    got = arrow_map(picked, run, "doc_id long, label int, at array<int>, x array<double>").dropDuplicates(["doc_id"])
    table = got.orderBy("doc_id").toArrow()
    return fit([(y, np.array(a), np.array(v)) for y, a, v in zip(*(table[n].to_pylist() for n in ("label", "at", "x")))])


def score_documents(docs: DataFrame, model: tuple) -> DataFrame:
    """(doc_id, score) for every row; an empty or null text is scored by its structure statistics.

    Row by row: repeated rows get equal scores, an empty table gives none. Further
    columns, lang and source among them, are never read; a null n_chars is counted.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)      # WIDTH x (RANK + 1) numbers, whatever the input

    def run(c):
        return {"doc_id": c["doc_id"], "score": [score(held.value, *x) for x in inputs(c["text"], c["n_chars"])]}

    return arrow_map(docs.select("doc_id", "text", "n_chars"), run, "doc_id long, score double")
