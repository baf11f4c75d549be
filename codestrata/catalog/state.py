"""Queries in the order of time: rate limits, eviction, bindings before a line."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import limits, scopes, sequence
from ..session import read_table
from .base import Registry

R = Registry()

LIMIT, DAY = 2, 86_400 * limits.SECOND      # accepted hits a user has in a day
CAP = 5120 << 20                            # bytes; the fixed default of the cache
KEEP = 1                                    # the entry about to be used


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


@R.query("rate_limits", f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, rn, event_id, [us] AS hits, true AS accepted, CAST(NULL AS BIGINT) AS retry_after FROM e WHERE rn = 1
      UNION ALL
      SELECT user_id, rn, event_id, CASE WHEN len(live) < {LIMIT} THEN list_append(live, us) ELSE live END, len(live) < {LIMIT},
             CASE WHEN len(live) >= {LIMIT} THEN greatest(1, ({DAY} - (us - list_min(live))) // 1000000 + 1) END
      FROM (SELECT e.*, list_filter(f.hits, lambda x: e.us - x < {DAY}) AS live FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
SELECT event_id, user_id, accepted, retry_after FROM f""")
def rate_limits(spark, sf_dir):
    """Whether each event is within its user's limit, and the seconds to wait where it isn't."""
    hits = read_table(spark, sf_dir, "events").select(
        F.lit("events").alias("bucket"), F.col("user_id").alias("client"), _micros("ts").alias("us"), F.col("event_id").alias("hit_id"))
    return limits.rate_limited(hits, LIMIT, DAY).select(
        F.col("hit_id").alias("event_id"), F.col("client").alias("user_id"), "accepted", "retry_after")


@R.query("cache_eviction", f"""
WITH c AS (SELECT o_orderkey AS key, o_orderdate AS used_at, CAST(round(o_totalprice * 100) AS BIGINT) AS bytes FROM orders),
g AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY used_at, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c WHERE key <> {KEEP})
SELECT key, bytes, (SELECT sum(bytes) FROM c) - before > {CAP} AS evicted FROM g UNION ALL SELECT key, bytes, false FROM c WHERE key = {KEEP}""")
def cache_eviction(spark, sf_dir):
    """Cache entries that go, least recently used first, until the rest fits under the cap; an order stands for an entry."""
    entries = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("used_at"), F.round(F.col("o_totalprice") * 100).cast("long").alias("bytes"))
    return sequence.evicted(entries, CAP, F.col("key") == KEEP).select("key", "bytes", "evicted")


# scopes are users within groups within the whole; every third group is a class, whose names its members don't see
_SCOPED = """
e AS (SELECT event_id, user_id, epoch_us(ts) AS line, event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS name FROM events),
b AS (SELECT CASE event_type WHEN 'purchase' THEN user_id WHEN 'signup' THEN -2 - user_id // 10 ELSE -1 END AS scope, name, line, event_id
      FROM e WHERE event_type IN ('purchase', 'signup', 'view')),
l AS (SELECT event_id, user_id, name, line FROM e WHERE event_type = 'click'),
c AS (SELECT l.*, user_id AS scope, 0 AS distance FROM l
      UNION ALL SELECT l.*, -2 - user_id // 10, 1 FROM l WHERE (user_id // 10) % 3 <> 0 UNION ALL SELECT l.*, -1, 2 FROM l)"""


@R.query("last_bindings", f"""
WITH {_SCOPED},
m AS (SELECT c.event_id, c.distance, b.event_id AS binding FROM c JOIN b ON b.scope = c.scope AND b.name = c.name AND b.line < c.line
      QUALIFY row_number() OVER (PARTITION BY c.event_id ORDER BY c.distance, b.line DESC, b.event_id DESC) = 1)
SELECT l.event_id, name, binding, CAST(distance AS INTEGER) AS distance FROM l LEFT JOIN m ON m.event_id = l.event_id""")
def last_bindings(spark, sf_dir):
    """The binding that each use of a name sees: the last one before it, in the innermost scope that has one."""
    e = read_table(spark, sf_dir, "events").select(
        "event_id", "user_id", _micros("ts").alias("line"), "event_type", (F.get_json_object("props", "$.k").cast("long") % 10).alias("name"))
    user, group, whole = F.col("user_id"), -2 - F.floor(F.col("user_id") / 10), F.lit(-1).cast("long")
    where = F.when(F.col("event_type") == "purchase", user).when(F.col("event_type") == "signup", group).when(F.col("event_type") == "view", whole)
    bindings = e.withColumn("scope", where).filter("scope is not null").select("scope", "name", "line", F.col("event_id").alias("binding"))
    tree = e.select(user.alias("scope"), group.alias("parent"), F.lit("function").alias("kind")).unionByName(e.select(
        group.alias("scope"), whole.alias("parent"), F.when(F.floor(user / 10) % 3 == 0, "class").otherwise("function").alias("kind"))).unionByName(
        e.limit(1).select(whole.alias("scope"), F.lit(None).cast("long").alias("parent"), F.lit("module").alias("kind"))).distinct()
    uses = e.filter("event_type = 'click'").select("event_id", user.alias("scope"), "name", "line")
    return scopes.resolve(uses, bindings, tree, width=7 * DAY).select("event_id", "name", "binding", "distance")
