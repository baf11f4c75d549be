"""Language-model scoring: prediction by partial matching over bytes, and a word unigram base.

The model is a trie of byte contexts of up to ORDER bytes, filled from all training
texts. A context gives a byte seen in it n / (total + distinct) and passes the rest,
distinct / (total + distinct), to the next shorter context, from which the bytes already
seen above are excluded. Below the empty context all bytes left are alike.

All contexts are kept. Those of two bytes, of which there are at most 256^2, and the HOT
most frequent ones of three bytes are worked out into code lengths once and sent to every
worker, a bounded table. The other three-byte contexts stay in a Spark table; what follows
them in a document is joined with their code lengths by context and summed per document.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import STEP, arrow_map, hash_texts, raw

ORDER = 3
HOT = 1 << 15           # three-byte contexts that are sent to every worker, at most
COLD = (1 << 16) - 1    # stands for a row of a context that stays in the Spark table
FLUSH = 1 << 22         # positions a worker gathers before it sums them up
FREQUENT = 100_000      # words whose counts are sent to every worker, at most
END_HASH = 0x5851F42D4C957F2D   # stands for the end of a text among the word hashes


def lowered(text: str | None) -> bytes:
    """A text in UTF-8 with A-Z in lower case; a null one is empty."""
    return raw(text).lower()


def grams(data: bytes) -> np.ndarray:
    """For each byte, it and the three before it in one number; zeros stand before the text."""
    b = np.frombuffer(b"\0" * ORDER + data, np.uint8).astype(np.uint32)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) over all texts; summed in the workers before anything is shuffled."""
    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def summed():
            g, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(n)], names=["gram", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.append(grams(lowered(text.as_py())))
                size += len(held[-1])
                if size >= FLUSH:
                    yield summed()
                    held, size = [], 0
        if size:
            yield summed()

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Coder:
    """Code lengths, in log10, of every byte after every hot context and every one of two bytes."""

    def __init__(self, three: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray],
                 cold: np.ndarray | None = None) -> None:
        """``two``: (gram of three bytes, count); ``three``: (gram of four bytes, count) of hot contexts.

        ``cold``: a bit for every three-byte context, set where it is in the Spark table.
        """
        short = np.zeros((256, 256, 256), np.float32)
        counts = np.zeros((256, 256, 256))
        g, n = two
        counts.reshape(-1)[g] = n
        one = counts.sum(0)                     # after one byte
        none = one.sum(0)
        base = self._below(none, np.full(256, 1 / 256), exclude=np.zeros(256, bool))
        first = np.stack([self._below(one[a], base, one[a] > 0, none) for a in range(256)])
        for a in range(256):
            for b in np.flatnonzero(counts[a].any(1)):
                short[a, b] = self._below(counts[a, b], first[b], counts[a, b] > 0, one[b])
            rest = ~counts[a].any(1)
            short[a, rest] = first[rest]
        g, n = three
        contexts, row = np.unique(g >> 8, return_inverse=True)
        self.row = np.zeros(1 << 24, np.uint16)
        self.row[contexts] = np.arange(1, len(contexts) + 1)
        if cold is not None:
            self.row[np.flatnonzero(np.unpackbits(cold.view(np.uint8), bitorder="little"))] = COLD
        long = np.zeros((len(contexts), 256))
        long[row, g & 255] = n
        lengths = [self._below(x, short.reshape(-1, 256)[c & 0xFFFF], x > 0, counts.reshape(-1, 256)[c & 0xFFFF])
                   for x, c in zip(long, contexts)]
        self.long = np.log10(np.array(lengths, np.float32).reshape(len(contexts), 256))
        self.short = np.log10(short).reshape(-1)

    @staticmethod
    def _below(n: np.ndarray, lower: np.ndarray, exclude: np.ndarray, lower_counts: np.ndarray | None = None) -> np.ndarray:
        """Probabilities after a context with counts ``n``, those of the shorter one being ``lower``."""
        seen = n > 0
        total, distinct = n.sum(), int(seen.sum())
        if not total:
            return lower
        left = lower[~seen].sum()
        out = np.where(seen, n / (total + distinct), 0.0)
        if left > 0:
            # symbol exclusion: what was seen here can't come from below, so the rest shares its room
            out = out + np.where(seen, 0.0, lower / left) * distinct / (total + distinct)
        else:
            out = n / total
        return out

    def log10(self, data: bytes) -> tuple[float, np.ndarray, np.ndarray]:
        """log10 probability of a text but for its grams after cold contexts; those, and how often each."""
        g = grams(data)
        row = self.row[g >> 8].astype(np.int32)
        late = row == COLD
        known = (row > 0) & ~late
        least = ~known & ~late
        return (float(self.long[row[known] - 1, g[known] & 255].sum(dtype=np.float64)
                      + self.short[g[least] & 0xFFFFFF].sum(dtype=np.float64)),
                *np.unique(g[late].astype(np.int64), return_counts=True))

    def codes(self, g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Of one context's grams the code lengths, and what an unseen byte has besides its length after two bytes."""
        lower = 10.0 ** self.short.reshape(-1, 256)[(g[0] >> 8) & 0xFFFF].astype(np.float64)
        seen = np.zeros(256, bool)
        seen[g & 255] = True
        room, left = n.sum() + len(n), lower[~seen].sum()
        if not left:
            return np.log10(n / n.sum()), 0.0           # no byte is unseen
        return np.log10(n / room), float(np.log10(len(n) / room / left))


def parted(counted: DataFrame) -> tuple[tuple, tuple, DataFrame]:
    """Grams after hot contexts, all of three bytes, and a table (context, gram, n) of the grams after cold contexts."""
    at = counted.withColumn("context", F.call_function("shiftright", F.col("gram"), F.lit(8)))
    two = counted.groupBy((F.col("gram") % (1 << 24)).alias("gram")).agg(F.sum("n").alias("n"))
    often = materialize(at.groupBy("context").agg(F.sum("n").alias("held")).orderBy(F.desc("held"), "context").limit(HOT)
                        .select("context"), "ppm-hot")

    def got(df):
        t = df.toArrow()
        return t["gram"].to_numpy(), t["n"].to_numpy()

    # at most 256 * HOT and 2^24 numbers
    return got(at.join(often, "context", "left_semi").select("gram", "n")), got(two), at.join(often, "context", "left_anti")


def train(docs: DataFrame, keep: Column) -> tuple:
    """Grams that the coder is built from, gathered from the whole texts for which ``keep`` holds."""
    return parted(materialize(gram_counts(docs.filter(keep)), "ppm-grams"))[:2]


def bits_of(contexts: DataFrame) -> np.ndarray:
    """A bit for each of the 2^24 contexts of three bytes, set for those in ``contexts``."""
    words = contexts.groupBy(F.call_function("shiftright", F.col("context"), F.lit(5)).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(context % 32))")).alias("bits")).toArrow()
    out = np.zeros((1 << 24) // 32, np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out


def cold_codes(cold: DataFrame, held) -> DataFrame:
    """(context, grams, codes, unseen) of every cold context; at most 256 grams each."""
    def run(c):
        coder = _coder(held)
        got = [coder.codes(np.array([x["gram"] for x in f]), np.array([x["n"] for x in f])) for f in c["follow"]]
        return {"context": c["context"], "grams": [[x["gram"] for x in f] for f in c["follow"]],
                "codes": [x for x, _ in got], "unseen": [x for _, x in got]}

    return arrow_map(cold.groupBy("context").agg(F.collect_list(F.struct("gram", "n")).alias("follow")), run,
                     "context long, grams array<long>, codes array<double>, unseen double")


_CODERS: dict[str, Coder] = {}


def _coder(held) -> Coder:
    name, grams_ = held.value
    if name not in _CODERS:
        _CODERS.clear()
        _CODERS[name] = Coder(*grams_)
    return _CODERS[name]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): 64-bit word hashes with their number of occurrences, ends of text included."""
    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def summed():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["word", "c"])

        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                texts = batch.column(0).slice(at, STEP).to_pylist()
                held += [*hash_texts([lowered(t) for t in texts]), np.full(len(texts), END_HASH, np.int64)]
                size += sum(map(len, held[-len(texts) - 1:]))
                if size >= FLUSH:
                    yield summed()
                    held, size = [], 0
        if size:
            yield summed()

    return docs.select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Frequent:
    """Counts of the most frequent words, to look up many hashes at a time."""

    def __init__(self, words: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, count) for each hash."""
        if not len(self.words):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        found = self.words[at] == h
        return found, np.where(found, self.counts[at], 0)


def score_documents(docs: DataFrame, keep: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Both models learn from the whole texts for which ``keep`` holds. A null text is
    empty: its only token is the end, its model score 0. With no training texts every
    byte costs log10 256, and every token's base is log10 1 (nothing is known). Repeated
    rows each give a row, null keys too; further columns are ignored.

    Base counts: those of the FREQUENT most frequent words go to the workers, a bounded
    table; occurrences of all others are joined with theirs by hash, so a frequent word
    never meets in one task. The model's cold contexts are joined in the same way.
    """
    spark = docs.sparkSession
    three, two, cold = parted(materialize(gram_counts(docs.filter(keep)), "ppm-grams"))
    grams_ = spark.sparkContext.broadcast((uuid.uuid4().hex, (three, two, bits_of(cold))))
    codes = materialize(cold_codes(cold, grams_), "ppm-cold")
    counts = materialize(word_counts(docs.filter(keep)), "word-counts")
    n_train, distinct = (v or 0 for v in counts.agg(F.sum("c"), F.count("c")).first())
    top = counts.orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow()
    frequent = Frequent(top["word"].to_numpy(), top["c"].to_numpy())
    floor = int(frequent.counts.min()) if len(frequent.counts) else 0
    table = spark.sparkContext.broadcast(frequent)      # at most FREQUENT entries
    below = np.log10(n_train + 0.5 * (distinct + 1))

    def run(c):
        out = {k: [] for k in ("doc_id", "n_tokens", "n_known", "base", "score", "rare", "times", "late", "lows", "often")}
        coder = _coder(grams_)
        texts = [lowered(t) for t in c["text"]]
        for key, data, h in zip(c["doc_id"], texts, hash_texts(texts)):
            h = np.append(h, END_HASH)
            found, n = table.value.find(h)
            rare, times = np.unique(h[~found], return_counts=True)
            out["doc_id"].append(key)
            out["n_tokens"].append(len(h))
            out["n_known"].append(int(found.sum()))
            out["base"].append(float(np.log10(n[found] + 0.5).sum() - below * len(h)))
            score, late, often = coder.log10(data)
            out["score"].append(score)
            out["late"].append(late)
            out["lows"].append(coder.short[late & 0xFFFFFF].astype(np.float64))
            out["often"].append(often)
            out["rare"].append(rare)
            out["times"].append(times)
        return out

    rows = arrow_map(
        docs.select("doc_id", "text"), run,
        "doc_id long, n_tokens long, n_known long, base double, score double, rare array<long>, times array<long>, "
        "late array<long>, lows array<double>, often array<long>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    asked = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select(
        "row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    rest = counts.filter(F.col("c") <= floor)           # the frequent ones among these are never asked for
    c = F.coalesce("c", F.lit(0))
    late = asked.join(rest, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(c + 0.5)).alias("more"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"))
    met = rows.select("row", F.explode(F.arrays_zip("late", "lows", "often")).alias("g")).select(
        "row", F.call_function("shiftright", F.col("g.late"), F.lit(8)).alias("context"), F.col("g.late").alias("gram"),
        F.col("g.lows").alias("low"), F.col("g.often").alias("often"))
    # a byte that the context has not seen comes from its two-byte one
    code = F.coalesce(F.get("codes", F.array_position("grams", F.col("gram")) - 1), F.col("low") + F.col("unseen"))
    long = met.join(codes, "context").groupBy("row").agg(F.sum(F.col("often") * code).alias("long"))
    return rows.drop("rare", "times", "late", "lows", "often").join(late, "row", "left").join(long, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("long", F.lit(0.0))).alias("score"))
