"""Document features for the trained classifiers, and bounded labelled samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

STRUCTURE = 12          # dense structure statistics of a document


def structure(data: bytes, h: np.ndarray, n_chars: int) -> np.ndarray:
    """Structure statistics of a text, all within about 0 to 1; zeros for an empty text.

    ``h`` holds the hashes of its words and ``n_chars`` its recorded length.
    """
    out = np.zeros(STRUCTURE)
    out[0] = np.log1p(max(n_chars, 0)) / 12
    if not data:
        return out
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    total, words = len(data), max(1, len(h))
    upper, lower = c[65:91].sum(), c[97:123].sum()
    out[1] = np.log1p(len(h)) / 10
    out[2] = upper / max(1, upper + lower)
    out[3] = min(1.0, c[[35, 36, 37, 38, 42, 60, 62, 64]].sum() / words)       # #$%&*<>@
    out[4] = min(1.0, c[124] / words)                                          # |
    out[5] = min(1.0, c[33] / words)                                           # !
    out[6] = min(1.0, c[48:58].sum() / total * 4)
    out[7] = min(1.0, total / words / 20)
    out[8] = float((h[1:] == h[:-1]).mean()) if len(h) > 1 else 0.0            # a word right after itself
    out[9] = 1 - len(np.unique(h)) / words
    lines = [x for x in data.split(b"\n") if x.strip()]
    out[10] = 1 - len(set(lines)) / max(1, len(lines))
    out[11] = min(1.0, c[[44, 46, 58, 59]].sum() / words)                      # ,.:;
    return out


def sample_labels(labels: DataFrame, label: str, keep: Column, rows: int) -> DataFrame:
    """At most ``rows`` labelled keys for which ``keep`` holds, chosen by a hash of the key.

    Rows with a null key or label are left out; of a key's repeated rows the largest label counts.
    """
    ok = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep)
    one = ok.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


class Adam:
    def __init__(self, shape, rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(shape), np.zeros(shape), 0, rate

    def step(self, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.001 * (grad * grad - self.v)
        return self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-8)
