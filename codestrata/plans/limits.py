"""Sliding-window rate limits: which hits are refused, and when to try again.

A refused hit is not counted, so each decision rests on the ones before it. But a hit that has
at most ``limit`` hits of any kind in its window is accepted whatever was decided before.
Only the others are folded in order of time, together with the hits their windows reach back
to, in runs between which a whole window is empty; all the rest is settled by window functions.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .sequence import last_so_far

SECOND = 1_000_000


def _marked(hits: DataFrame, limit: int, window: int) -> DataFrame:
    """``hits`` with doubtful (more than ``limit`` hits in its window), involved (a doubtful one's
    window reaches back to it) and starts (its time, where no involved hit is in its window before it).

    Each hit is sent to the slots of one window's length around its own that can ask for it, which
    spreads a busy client over its slots and keeps a slot's rows to four windows.
    """
    slot = F.floor(F.col("us") / window)
    sent = hits.withColumn("home", slot).withColumn("slot", F.explode(F.sequence(slot - 1, slot + 2)))
    span = Window.partitionBy("bucket", "client", "slot").orderBy("us")
    back, ahead = span.rangeBetween(-(window - 1), 0), span.rangeBetween(0, window - 1)
    sent = sent.withColumn("doubtful", F.count(F.lit(1)).over(back) > limit)
    sent = sent.withColumn("involved", F.max("doubtful").over(ahead))
    first = F.min(F.when(F.col("involved"), F.col("us"))).over(back) == F.col("us")
    return sent.withColumn("starts", F.when(F.col("involved") & first, F.col("us"))).filter("slot = home").drop("slot", "home")


def rate_limited(hits: DataFrame, limit: int, window: int) -> DataFrame:
    """(bucket, client, us, hit_id, accepted, retry_after) of every hit.

    ``hits``: bucket, client, us (microseconds), hit_id, which orders hits of the same time and is
    unique. ``window`` is in microseconds. A hit is accepted while fewer than ``limit`` accepted hits
    of its bucket and client are less than a window old, else retry_after tells the whole seconds, at
    least 1, until the oldest of them leaves. Hits without a time are left out; null buckets
    and clients are ones like others.
    """
    marked = _marked(hits.select("bucket", "client", "us", "hit_id").filter("us is not null"), limit, window)
    quiet = marked.filter("not involved").select(
        "bucket", "client", "us", "hit_id", F.lit(True).alias("accepted"), F.lit(None).cast("long").alias("retry_after"))
    busy = last_so_far(marked.filter("involved").select("bucket", "client", "us", "hit_id", "doubtful", "starts"),
                       ["bucket", "client"], "us", "starts", 1000 * window, "run")
    dealt = busy.repartition("bucket", "client", "run").sortWithinPartitions("bucket", "client", "run", "us", "hit_id")
    folded = dealt.select("bucket", "client", "run", "us", "hit_id", "doubtful").mapInArrow(_fold(limit, window), quiet.schema)
    return quiet.unionByName(folded)


def _fold(limit: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, deque()       # accepted hits of the window: at most ``limit`` and those beyond doubt
        for batch in batches:
            accepted, retry = [], []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5)]
            for bucket, client, start, us, doubtful in zip(*columns):
                if (bucket, client, start) != key:
                    key, held = (bucket, client, start), deque()
                while held and us - held[0] >= window:
                    held.popleft()
                if doubtful and len(held) >= limit:
                    accepted.append(False)
                    retry.append(max(1, (window - (us - held[0])) // SECOND + 1))
                else:
                    held.append(us)
                    accepted.append(True)
                    retry.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(accepted), pa.array(retry, pa.int64())],
                names=["bucket", "client", "us", "hit_id", "accepted", "retry_after"])
    return run
