"""Sharding by extendible hashing. DataFrame operations only.

A directory maps prefixes of a 60-bit document hash to shards. The root holds
everything; a shard over its byte limit splits on its next hash bit, and only such
a shard does, until all fit.

Sizes are summed once on short prefixes ("cells", some 256 to a shard), and the
directory is worked out over those sums; only the rows of a cell that is itself too
large are looked at again with more bits. So the text is read once and never moved.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

BITS = 60               # hash bits that a directory may use
LIMIT = 1 << 20         # bytes of text in a shard
FINER = 8               # bits that cells have beyond the expected depth


def hash_bits(key: Column) -> Column:
    """First 60 bits of the key's MD5, as a long; a null key hashes as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def prefix(h: Column, bits: Column | int) -> Column:
    return F.call_function("shiftright", h, (F.lit(BITS) - bits).cast("int"))


def split_cells(cells: DataFrame, first: int, last: int, limit: int) -> DataFrame:
    """(cell, n_bytes) sums on ``last`` bits to (cell, depth, fits).

    depth is the least in first..last at which the cell's prefix holds no more than
    ``limit`` bytes; where none does, depth is ``last`` and fits is false.
    """
    levels = cells.select("cell", "n_bytes", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("depth"))
    part = F.call_function("shiftright", F.col("cell"), (F.lit(last) - F.col("depth")).cast("int"))
    levels = levels.withColumn("part", part)
    small = levels.groupBy("depth", "part").agg(F.sum("n_bytes").alias("held")).filter(F.col("held") <= limit)
    least = levels.join(small, ["depth", "part"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell").join(least, "cell", "left").select(
        "cell", F.coalesce("depth", F.lit(last)).alias("depth"), F.col("depth").isNotNull().alias("fits"))


def assign_shards(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, depth, prefix, shard_bytes, fits.

    (depth, prefix) names the shard. Nulls: a null text has 0 bytes, a null key hashes
    as the empty text. Rows with equal keys share a hash and so always a shard. A
    single key with more bytes than the limit gets a shard of its own at the full depth,
    with fits = false, as no bit can part it. An empty table gives no rows. Further
    columns are ignored.
    """
    rows = docs.select(F.col(key).alias("key"), hash_bits(F.col(key)).alias("h"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    rows = materialize(rows, "shard-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    first, last = 0, min(BITS, max(1, ceil(log2(max(2, total / limit)))) + FINER)
    left, placed = rows, None
    while True:
        celled = left.withColumn("cell", prefix(F.col("h"), last))
        cells = celled.groupBy("cell").agg(F.sum("n_bytes").alias("n_bytes"))
        found = materialize(split_cells(cells, first, last, limit), "shard-cells")
        joined = celled.join(found, "cell")
        done = joined if last == BITS else joined.filter("fits")
        done = done.select("key", "n_bytes", "depth", prefix(F.col("h"), F.col("depth")).alias("prefix"), "fits")
        placed = done if placed is None else placed.unionByName(done)
        if last == BITS or found.filter("not fits").isEmpty():
            break
        left = joined.filter("not fits").select("key", "h", "n_bytes")
        first, last = last + 1, min(BITS, last + 16)
    placed = materialize(placed, "shard-placed")
    sizes = placed.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("shard_bytes"))
    return placed.join(sizes, ["depth", "prefix"]).select(
        F.col("key").alias(key), "n_bytes", "depth", "prefix", "shard_bytes", "fits")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` with one folder per shard: ``path``/shard=<depth>-<prefix>.

    A key without a row in the assignment can't occur, as it is made from ``docs``.
    """
    name = F.concat_ws("-", "depth", "prefix").alias("shard")
    where = assign_shards(docs, limit, key, text).select(F.col(key).alias("_key"), name).distinct()
    docs.join(where, F.col(key).eqNullSafe(F.col("_key"))).drop("_key").repartition("shard").write.partitionBy(
        "shard").parquet(path)
