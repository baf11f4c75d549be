"""The state queries as streams: events come as files in order of time, each stream is run to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import read_table
from ..streaming import feeds, folds
from .activity import R as BATCH
from .base import Registry

R = Registry()

SLICES = 3                          # files' worth of micro-batches
DAY = 86_400_000_000
BEAT, CAP = 2 * DAY, 5 * DAY        # the table's events are days apart, so are heartbeats and time limits
FINAL = ("error",)
TTL = DAY
TOGETHER = 2000                     # events of the keys that share a state, about


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"))


def _packs(events) -> int:
    return events.count() // TOGETHER + 1


@R.query("stream_latest_states", BATCH.sql["latest_states"])
def stream_latest_states(spark, sf_dir):
    """As latest_states, kept up to date by a stream; repeated and late updates change nothing."""
    at = F.struct("us", "event_id")
    stream = feeds.feed(_events(spark, sf_dir), SLICES)
    states = stream.groupBy("user_id").agg(
        F.max_by("event_type", at).alias("status"), F.max_by("value", F.when(F.col("value").isNotNull(), at)).alias("progress"),
        F.max("ts").cast("timestamp_ntz").alias("updated"))
    return feeds.drained_updates(states, ["user_id"], "latest-states")


@R.query("stream_progress_frames", f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type AS status, CAST(json_extract(props, '$.k') AS BIGINT) // 50 AS stage,
                     row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, rn, event_id, us, status, stage, us AS opened, us AS beat, true AS shown, status = 'error' AS closed FROM e WHERE rn = 1
      UNION ALL
      SELECT user_id, rn, event_id, us, status, stage, CASE WHEN fresh THEN us ELSE opened END, CASE WHEN shown THEN us ELSE beat END, shown, status = 'error'
      FROM (SELECT *, fresh OR changed AS shown FROM (
        SELECT e.*, f.opened, f.beat + greatest(0, (e.us - 1 - f.beat) // {BEAT}) * {BEAT} AS beat, f.closed OR f.opened + {CAP} < e.us AS fresh,
               e.status IS DISTINCT FROM f.status OR e.stage IS DISTINCT FROM f.stage AS changed
        FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))),
g AS (SELECT *, lead(us, 1, 9000000000000000000) OVER (PARTITION BY user_id ORDER BY rn) AS nxt FROM f),
o AS (SELECT * FROM g WHERE NOT closed)
SELECT user_id, us AS at, 'frame' AS kind, status, event_id FROM g WHERE shown
UNION ALL SELECT user_id, beat + k * {BEAT}, 'heartbeat', NULL, NULL FROM o, range(1, {CAP // BEAT + 2}) AS t(k) WHERE beat + k * {BEAT} < least(nxt, opened + {CAP})
UNION ALL SELECT user_id, opened + {CAP}, 'timeout', NULL, NULL FROM o WHERE opened + {CAP} < nxt""")
def stream_progress_frames(spark, sf_dir):
    """Frames, heartbeats and timeouts that a watcher of each user's scans gets."""
    events = _events(spark, sf_dir).select(
        "event_id", "user_id", "us", F.col("event_type").alias("status"), F.floor(F.col("k") / 50).alias("stage"))
    stream = feeds.feed(events, SLICES, close_after=30 * DAY)
    return feeds.drained(folds.folded(stream, "user_id", "long", folds.Progress(BEAT, CAP, FINAL), "1 hour", _packs(events)), "progress-frames")


@R.query("stream_cached_lookups", f"""
WITH RECURSIVE e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS name, epoch_us(ts) AS us,
                     row_number() OVER (PARTITION BY json_extract(props, '$.k') ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT name, rn, event_id, us AS fetched, false AS hit FROM e WHERE rn = 1
      UNION ALL SELECT e.name, e.rn, e.event_id, CASE WHEN e.us - f.fetched < {TTL} THEN f.fetched ELSE e.us END, e.us - f.fetched < {TTL}
      FROM f JOIN e ON e.name = f.name AND e.rn = f.rn + 1)
SELECT name, event_id, hit FROM f""")
def stream_cached_lookups(spark, sf_dir):
    """Which lookups find a cached answer young enough; the state of a name lives as long as its answer."""
    events = _events(spark, sf_dir).select("event_id", F.col("k").alias("name"), "us")
    stream = feeds.feed(events, SLICES, close_after=30 * DAY)
    return feeds.drained(folds.folded(stream, "name", "long", folds.Cache(TTL), "1 hour", _packs(events)), "cached-lookups")
