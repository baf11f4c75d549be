"""Quality rules. DataFrame operations only.

Base rules count words, symbols, repeated lines and words in repeated 8-word windows.
Beyond them, each language and source (where they have too few documents, the language,
else the whole table) gets a robust centre and scatter of transformed statistics by the
minimum covariance determinant (concentration steps over the nearest half of its
documents, until no determinant falls), and a document too far from them by Mahalanobis
distance is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import BLANKS, SPACES, let

MIN_WORDS = 20
MAX_REPEAT = 30         # percent of words in repeated windows
WINDOW = 8
SYMBOLS = "#*$%&|<>"    # fixed value
SHARES = [x / 100 for x in range(50, 101)]      # of a group's rows, to cut at the one that has the least half
FALL = 1e-3             # least fall of a determinant's logarithm that counts as one
CUTOFF = 60.0           # squared distance beyond which a document goes
LEAST = 40              # smaller groups are judged by the fit of their language, or of the whole table
WHOLE = "all"           # the fit of the whole table
# A statistic's spread is at least this, so that a constant one can't blow up distances.
FLOORS = {"word_length": 0.05, "symbols": 0.25, "dup_lines": 0.25, "repeats": 0.05}
CHI_MEDIAN = 3.357      # median of the chi-square distribution with four degrees


def repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in ``words``."""
    wins = F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
                    lambda i: F.xxhash64(F.slice(words, i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(hashes: Column) -> Column:
        at = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(at, lambda a: let(
            F.sort_array(F.transform(
                F.filter(a, lambda x, i: F.coalesce((F.get(a, i - 1)["h"] == x["h"]), F.lit(False))
                         | F.coalesce((F.get(a, i + 1)["h"] == x["h"]), F.lit(False))),
                lambda x: x["i"])),
            lambda pos: F.aggregate(
                pos, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
                lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
            )["n"]))

    return let(wins, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base statistics of every text; a null text has none of anything."""
    whole = F.coalesce(F.col(text), F.lit(""))
    inner = F.btrim("text", F.lit(BLANKS))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    base = docs.select(F.col(key).alias("doc_id"), "lang", "source", whole.alias("text"))
    base = base.withColumn("words", F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACES)))
    return base.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def transformed() -> dict[str, Column]:
    """The statistics that distances are taken over, roughly symmetric and free of length."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        "symbols": F.log1p(100 * F.col("n_symbols") / words),
        "dup_lines": F.log1p(100 * F.col("n_dup_lines") / words),
        "repeats": F.col("n_repeat_words") / words,
    }


def cholesky(names: list[str]) -> list[tuple[str, Column]]:
    """Columns l_i_j of the factor of the covariances c_i_j, to be added one after another."""
    out = []
    for i in range(len(names)):
        for j in range(i + 1):
            rest = F.col(f"c_{j}_{i}" if j <= i else f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            # the floor also keeps the factor real where rounding makes a tiny pivot negative
            got = F.sqrt(F.greatest(rest, F.lit((FLOORS[names[i]] / 4) ** 2))) if i == j else rest / F.col(f"l_{j}_{j}")
            out.append((f"l_{i}_{j}", got))
    return out


def distanced(rows: DataFrame, fits: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with their squared Mahalanobis distance d under their fit."""
    out = rows.join(fits, "fit")
    for i, name in enumerate(names):
        z = F.col(name) - F.col(f"m_{i}")
        for k in range(i):
            z = z - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        out = out.withColumn(f"z_{i}", z / F.col(f"l_{i}_{i}"))
    d = sum((F.col(f"z_{i}") ** 2 for i in range(1, len(names))), F.col("z_0") ** 2)
    return out.select(*rows.columns, d.alias("d"))


def estimate(rows: DataFrame, names: list[str]) -> DataFrame:
    """Mean m_i and factor l_i_j for every fit over ``rows``."""
    p = range(len(names))
    fits = rows.groupBy("fit").agg(
        *[F.avg(names[i]).alias(f"m_{i}") for i in p],
        *[F.covar_pop(names[i], names[j]).alias(f"c_{i}_{j}") for i in p for j in p if i <= j])
    for i in p:
        fits = fits.withColumn(f"c_{i}_{i}", F.col(f"c_{i}_{i}") + F.lit(FLOORS[names[i]] ** 2))
    for name, value in cholesky(names):
        fits = fits.withColumn(name, value)
    return fits.drop(*[f"c_{i}_{j}" for i in p for j in p if i <= j])


def concentrated(judged: DataFrame, start: DataFrame, names: list[str]) -> DataFrame:
    """Fits over the nearest half of their rows, concentrated until the determinant of none of them falls.

    Each turn lowers at least one determinant by FALL, and the floors bound them from
    below, so it ends; a fit whose determinant has stopped falling sits out the turns left.
    """
    values = [c for c in start.columns if c[:2] in ("m_", "l_")]
    fits = materialize(start.select("fit", *values).withColumns({"det": F.lit(float("inf")), "falls": F.lit(True)}), "mcd-start")
    while True:
        near = distanced(judged, fits.filter("falls").drop("det", "falls"), names)
        n = F.col("n")
        half = F.ceil(100 * F.floor((n + len(names) + 1) / 2) / n) - 50
        cuts = near.groupBy("fit").agg(F.percentile_approx("d", SHARES, 1000).alias("cut"), F.count(F.lit(1)).alias("n")).select(
            "fit", F.get("cut", F.least(half, F.lit(len(SHARES) - 1)).cast("int")).alias("cut"))
        new = estimate(near.join(cuts, "fit").filter(F.col("d") <= F.col("cut")), names)
        new = new.select("fit", *[F.col(v).alias(f"new_{v}") for v in values],
                         sum(2 * F.log(F.col(f"l_{i}_{i}")) for i in range(len(names))).alias("new_det"))
        falls = F.coalesce(F.col("new_det") < F.col("det") - FALL, F.lit(False))
        fits = materialize(fits.join(new, "fit", "left").select(
            "fit", *[F.when(falls, F.col(f"new_{v}")).otherwise(F.col(v)).alias(v) for v in [*values, "det"]],
            falls.alias("falls")), "mcd-step")
        if fits.filter("falls").isEmpty():
            return fits.drop("det", "falls")


def choices(judged: DataFrame, everyone: DataFrame) -> DataFrame:
    """(group, fit, fits): the fit that judges a group, and those that its rows are part of.

    A group of LEAST judged rows or more has its own; a smaller one takes that of its
    language, or of the whole table where the language has fewer rows, too.
    """
    n = judged.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialize(everyone.select("group", "of_lang").distinct().join(n, "group", "left").na.fill(0, ["n"]), "mcd-sizes")
    langs = sizes.groupBy("of_lang").agg(F.sum("n").alias("n_lang"), F.min("n").alias("least"))
    whole = langs.agg(F.coalesce(F.min("n_lang") < LEAST, F.lit(False)).alias("whole"))
    own, lang = F.col("n") >= LEAST, F.col("n_lang") >= LEAST
    return materialize(sizes.join(langs, "of_lang").crossJoin(F.broadcast(whole)).select(
        "group", F.when(own, F.col("group")).when(lang, F.col("of_lang")).otherwise(WHOLE).alias("fit"),
        F.filter(F.array(F.when(own, F.col("group")), F.when(lang & (F.col("least") < LEAST), F.col("of_lang")),
                         F.when(F.col("whole"), F.lit(WHOLE))), lambda x: x.isNotNull()).alias("fits")), "mcd-choices")


def mcd_distances(stats: DataFrame) -> DataFrame:
    """doc rows with squared robust distance d under the fit of their group, language or the whole table."""
    names = list(transformed())
    null = F.lit("\x01")
    rows = stats.select("*", F.concat_ws("\x00", F.lit("group"), F.coalesce("lang", null), F.coalesce("source", null)).alias("group"),
                        F.concat_ws("\x00", F.lit("lang"), F.coalesce("lang", null)).alias("of_lang"),
                        *[c.alias(n) for n, c in transformed().items()])
    long_ = rows.filter(F.col("n_words") >= MIN_WORDS)
    chosen = choices(long_, rows)
    judged = materialize(long_.join(chosen, "group").select(F.explode("fits").alias("fit"), *names), "mcd-rows")
    # start: distance from the medians, each statistic on its own
    middle = materialize(judged.groupBy("fit").agg(
        *[F.percentile_approx(n, 0.5, 1000).alias(f"m_{i}") for i, n in enumerate(names)]), "mcd-middle")
    off = judged.join(middle, "fit").select("fit", *names, *[F.abs(F.col(n) - F.col(f"m_{i}")).alias(f"a_{i}") for i, n in enumerate(names)])
    spread = off.groupBy("fit").agg(
        *[F.percentile_approx(f"a_{i}", 0.5, 1000).alias(f"s_{i}") for i in range(len(names))])
    fits = middle.join(spread, "fit")
    for i, n in enumerate(names):
        for j in range(i + 1):
            fits = fits.withColumn(f"l_{i}_{j}", F.sqrt((1.4826 * F.col(f"s_{i}")) ** 2 + FLOORS[n] ** 2) if i == j else F.lit(0.0))
    fits = concentrated(judged, fits, names)
    last = distanced(judged, fits, names).groupBy("fit").agg(F.percentile_approx("d", 0.5, 1000).alias("mid"))
    # a scatter made of the nearest half is too small: widen it to a normal median,
    # never narrow it, for floors may have widened it already
    scaled = fits.join(last, "fit").withColumn("widen", F.greatest(F.lit(1.0), F.col("mid") / CHI_MEDIAN))
    # few rows: a join by group, then one by fit, would deal all small groups to one task
    far = rows.join(chosen.select("group", "fit").join(scaled, "fit", "left"), "group", "left")
    for i, name in enumerate(names):
        z = F.col(name) - F.col(f"m_{i}")
        for k in range(i):
            z = z - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        far = far.withColumn(f"z_{i}", z / F.col(f"l_{i}_{i}"))
    d = sum((F.col(f"z_{i}") ** 2 for i in range(1, len(names))), F.col("z_0") ** 2) / F.col("widen")
    return far.select(*stats.columns, d.alias("distance"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics, base verdict, distance and final verdict of every row of ``docs``.

    Null or empty text: no words, so base_failed. Null lang or source: a group of its
    own. Groups with fewer than LEAST judged documents: the fit of their language, or
    else of the whole table, whatever its size; distance is null only where no row of
    the table has MIN_WORDS words. Repeated rows are judged each for itself. Empty table: no rows. Further
    columns are ignored.
    """
    stats = materialize(statistics(docs, key, text), "quality-stats")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return mcd_distances(stats).withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF))
