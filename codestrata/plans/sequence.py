"""Work in the order of time or lines: last value before a row, running totals.

No window covers a whole key or a whole table. A key's rows are cut into slices of its
order, each slice is worked on by itself, and what a slice needs from the ones before comes
from one row for each key and slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize


def _carried(rows: DataFrame, keys: Sequence[str], order: list[Column]) -> DataFrame:
    """(keys, _slice, _carried): the last non-null _value in the slices before."""
    at = F.when(F.col("_value").isNotNull(), F.struct(*order))
    per = rows.groupBy(*keys, "_slice").agg(F.max_by("_value", at).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).drop("_last")


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Equality of all ``names``, nulls being equal."""
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out


def as_of(lookups: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, value: str, width: int, last_of: str | None = None) -> DataFrame:
    """``lookups`` with the ``value`` of the last fact of the same keys strictly before ``at``.

    ``at`` is a whole number in both, cut into slices of ``width``. Of facts at the same place the one
    with the greatest ``last_of`` counts, or the greatest value. Facts with a null value or place are no
    facts; a lookup with a null place finds none; null keys are equal to each other. Rows
    of ``lookups`` are kept as they are, ``value`` is null where there is no fact.
    """
    mine = [c for c in lookups.columns if c not in keys and c != at]
    tie = F.col(last_of or value)
    nothing = facts.select(F.struct(tie.alias("t"), F.col(value).alias("v")).alias("x")).schema["x"].dataType
    kept = lookups.filter(F.col(at).isNotNull()).select(
        *keys, at, F.lit(0).alias("_kind"), F.struct(F.lit(True).alias("_is"), *mine).alias("_row"), F.lit(None).cast(nothing).alias("_value"))
    row = kept.schema["_row"].dataType
    known = facts.filter(F.col(at).isNotNull() & F.col(value).isNotNull()).select(
        *keys, at, F.lit(1).alias("_kind"), F.lit(None).cast(row).alias("_row"), F.struct(tie.alias("t"), F.col(value).alias("v")).alias("_value"))
    every = kept.unionByName(known).withColumn("_slice", F.floor(F.col(at) / width))
    # lookups come before the facts of their place
    order = [F.col(at), F.col("_kind"), F.col("_value.t")]
    so_far = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = every.withColumn("_here", F.last("_value", ignorenulls=True).over(so_far)).filter("_kind = 0")
    before = _carried(every, keys, order)
    joined = here.join(before, _same(here, before, [*keys, "_slice"]), "left")
    found = joined.select(*[here[k] for k in keys], here[at], *[F.col(f"_row.{c}").alias(c) for c in mine],
                          F.coalesce("_here", "_carried")["v"].alias(value))
    lost = lookups.filter(F.col(at).isNull()).withColumn(value, F.lit(None).cast(found.schema[value].dataType))
    return found.select(*lookups.columns, value).unionByName(lost.select(*lookups.columns, value))


def last_so_far(rows: DataFrame, keys: Sequence[str], at: str, value: str, width: int, out: str) -> DataFrame:
    """``rows`` with ``out``: the last non-null ``value`` up to and with each row's place."""
    every = rows.withColumn("_value", F.col(value)).withColumn("_slice", F.floor(F.col(at) / width))
    order = [F.col(at), F.col("_value")]
    so_far = Window.partitionBy(*keys, "_slice").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    here = every.withColumn("_here", F.max(F.when(F.col("_value").isNotNull(), F.struct(*order))).over(so_far))
    before = _carried(every, keys, order)
    joined = here.join(before, _same(here, before, [*keys, "_slice"]), "left")
    return joined.select(*[here[c] for c in rows.columns], F.coalesce(here["_here"]["_value"], "_carried").alias(out))


def running_totals(rows: DataFrame, order: Sequence[str], size: str, label: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``size`` over all rows that come earlier in ``order``.

    Two levels: rows are dealt by ranges of the order and written down with their range; each range
    is summed by itself and takes over the total of the ranges before it, found among one row for
    each range. ``order`` has to tell rows apart, else equal rows come in any order.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), label)
    totals = dealt.groupBy("_part").agg(F.sum(size).alias("_total"))        # as many rows as ranges
    offsets = totals.select("_part", (F.sum("_total").over(Window.orderBy("_part")) - F.col("_total")).alias("_offset"))
    inner = F.sum(size).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    return dealt.withColumn("_inner", inner).join(F.broadcast(offsets), "_part").select(
        *rows.columns, (F.col("_offset") + F.col("_inner")).alias("before"))


def evicted(entries: DataFrame, cap: int, keep: Column) -> DataFrame:
    """``entries`` (key, used_at, bytes) with ``evicted``: what goes until the rest fits into ``cap`` bytes.

    Least recently used first, of equal times the least key; entries that ``keep`` names count but
    never go. A null time is the oldest, null bytes are none.
    """
    rows = entries.withColumns({"_kept": F.coalesce(keep, F.lit(False)), "_bytes": F.coalesce(F.col("bytes"), F.lit(0))})
    total = rows.agg(F.coalesce(F.sum("_bytes"), F.lit(0)).alias("n")).first().n
    gone = running_totals(rows.filter("not _kept"), ["used_at", "key"], "_bytes", "cache-entries")
    gone = gone.withColumn("evicted", F.lit(total) - F.col("before") > cap).select(*entries.columns, "evicted")
    return gone.unionByName(rows.filter("_kept").select(*entries.columns, F.lit(False).alias("evicted")))
