"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLANKS = " \t\n\x0b\x0c\r"          # fixed value: what parts words in every contract
SPACES = r"[ \t-\r]+"
STEP = 512                           # rows a worker holds decoded at a time


def arrow_map(df: DataFrame, fn: Callable[[dict], dict], schema: str, done: Callable[[], None] | None = None) -> DataFrame:
    """Apply ``fn`` to small column dictionaries of each partition.

    ``fn`` takes and returns {column: list or array}. Batches are cut to STEP rows,
    so that a run of very long texts never stands decoded in memory at once. ``done``
    runs at the end of a partition: workers live on, so what they remember is dropped there.
    """
    names, out_names = df.columns, [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, STEP):
                    part = batch.slice(at, STEP)
                    got = fn({n: part.column(i).to_pylist() for i, n in enumerate(names)})
                    yield pa.RecordBatch.from_arrays([_array(got[n], kinds[n]) for n in out_names], names=out_names)
        finally:
            if done is not None:
                done()
            pa.default_memory_pool().release_unused()

    kinds = {f.split()[0]: _kind(f.split(None, 1)[1].strip()) for f in schema.split(",")}
    return df.mapInArrow(run, schema)


def _kind(name: str) -> pa.DataType:
    simple = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
              "double": pa.float64(), "boolean": pa.bool_()}
    if name.startswith("array<"):
        return pa.list_(_kind(name[6:-1]))
    return simple[name]


def _array(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values, kind)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` parts at exactly the six blanks."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """As words_of, with A-Z (and no other letter) in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (an invertible mix)."""
    h = h.view(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Signed 64-bit hash of each run of ``width`` word hashes; order matters."""
    n = len(h) - width + 1
    h = h.view(np.uint64)
    out = h[:n].copy()
    for k in range(1, width):
        out = (out ^ (out >> np.uint64(31))) * _ODD + h[k:k + n]
    return mixed(out).view(np.int64)


_RANDOM = np.random.default_rng(20)
_OF_BYTE = _RANDOM.integers(0, 1 << 64, 256, np.uint64)
_OF_PLACE = _RANDOM.integers(0, 1 << 63, 1024, np.uint64) * np.uint64(2) + np.uint64(1)
_IN_WORD = np.array([chr(b) not in BLANKS for b in range(256)])
GROUP = 1 << 20         # bytes hashed at a time; a longer text is a group of its own


def hash_texts(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the signed 64-bit hashes of its words, in order.

    A word's hash sums a random number for each byte times one for its place, so that a
    whole group of texts is hashed by a few array operations.
    """
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= GROUP:
            size += len(texts[end])
            end += 1
        out += _hash_group(texts[at:end])
        at = end
    return out


def _hash_group(texts: list[bytes]) -> list[np.ndarray]:
    buf = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    inside = _IN_WORD[buf]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, size = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return [np.zeros(0, np.int64)] * len(texts)
    place = np.flatnonzero(inside)
    inner = place - np.repeat(starts, size)
    factor = _OF_PLACE[inner & 1023]
    if size.max() > len(_OF_PLACE):         # further on the table's numbers are mixed with the thousand
        far = np.flatnonzero(inner > 1023)
        factor[far] = mixed(factor[far] + (inner[far] >> 10).astype(np.uint64) * _ODD) | np.uint64(1)
    values = _OF_BYTE[buf[place]] * factor
    h = np.add.reduceat(values, np.cumsum(size) - size)
    h = mixed(h + size.astype(np.uint64) * _ODD).view(np.int64)
    bounds = 1 + np.cumsum([0] + [len(t) + 1 for t in texts])
    cut = np.searchsorted(starts, bounds)
    return [h[i:j] for i, j in zip(cut[:-1], cut[1:])]


def raw(text: str | None) -> bytes:
    """A text as UTF-8; a null one is empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def crc_mod(column: str, by: int) -> Column:
    """Remainder of crc32 over the column's text; a null column counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % by


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it many times inside ``then``."""
    return F.transform(F.array(value), then)[0]


FILTER_BITS = 1 << 27   # 16 MB
SPARSE = 64             # bits for each key that a filter needs at most


def bit_filter(keys: DataFrame, column: str) -> np.ndarray:
    """At most FILTER_BITS bits, one of which each key sets; few keys have a small filter.

    It only spares rows a shuffle that ends in an exact join; where it is full, it spares none.
    Every executor writes what is sent to Python to its disk, so bits that few keys don't need are folded away.
    """
    bit = F.pmod(column, F.lit(FILTER_BITS))
    words = keys.groupBy(F.call_function("shiftright", bit, F.lit(5)).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, int(pmod({column}, 32)))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    used = int(np.bitwise_count(out).sum())
    while len(out) > 32 and len(out) * 16 >= SPARSE * used:      # halves that are still sparse enough as one
        half = len(out) // 2
        out = out[:half] | out[half:]
    return out


def holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & (32 * len(bits) - 1)
    return (bits[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).astype(bool)
