"""Streams fed in several batches, with events late, too late, repeated and out of order."""

import random

import pytest
from pyspark.sql import functions as F

from codestrata.plans import limits
from codestrata.streaming import feeds, folds

S = 1_000_000
SCHEMA = "event_id long, user_id long, us long, status string, stage long"


def stream(spark, path, batches):
    """One micro-batch for each list of rows."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.timestamp_micros("us"))


def frames_brute(events, beat, cap, final):
    out = []
    for user in {e[1] for e in events}:
        memory = None

        def silent(until):
            nonlocal memory
            while memory:
                due = min(memory["beat"] + beat, memory["opened"] + cap)
                if due >= until:
                    return
                out.append((user, due, "timeout" if due == memory["opened"] + cap else "heartbeat", None, None))
                memory = None if out[-1][2] == "timeout" else memory | {"beat": due}

        for i, _, us, status, stage in sorted((e for e in events if e[1] == user), key=lambda e: (e[2], e[0])):
            silent(us)
            if memory is None or memory["sign"] != (status, stage):
                memory = {"opened": memory["opened"] if memory else us, "sign": (status, stage), "beat": us}
                out.append((user, us, "frame", status, i))
            if status in final:
                memory = None
        silent(10 ** 18)
    return sorted(out, key=repr)


def test_progress(spark, tmp_path):
    rng = random.Random(6)
    events, us = [], 10 ** 15
    for i in range(300):
        us += rng.choice([0, 1, 5 * S, 20 * S, 100 * S, 400 * S])
        events.append((i, rng.choice([1, 1, 1, 2, 3]), us, rng.choice(["run", "run", "wait", "error", "complete"]), rng.choice([1, 2, None])))
    mixed = sorted(events, key=lambda e: e[2] + rng.randrange(100 * S))         # out of order by less than the delay
    cuts = [mixed[:100], mixed[100:200] + mixed[40:60], mixed[200:] + mixed[150:160]]       # some repeated
    too_late = (900, 1, 10 ** 15 + 1, "late", 1)
    close = (None, None, us + 10 ** 5 * S, None, None)
    source = stream(spark, str(tmp_path), [*cuts, [too_late], [close]])
    fold = folds.Progress(15 * S, 360 * S, ("error", "complete"))
    got = feeds.drained(folds.folded(source, "user_id", "long", fold, "100 seconds"), "t").collect()
    assert sorted(((r.user_id, r.at, r.kind, r.status, r.event_id) for r in got), key=repr) == frames_brute(events, 15 * S, 360 * S, ("error", "complete"))


def test_cache(spark, tmp_path):
    rng = random.Random(2)
    events, us = [], 10 ** 15
    for i in range(200):
        us += rng.choice([1, 600 * S, 1800 * S, 3600 * S])
        events.append((i, rng.choice([1, 2, 3]), us, None, None))
    source = stream(spark, str(tmp_path), [events[:90], events[90:], [(None, None, us + 10 ** 6 * S, None, None)]])
    got = feeds.drained(folds.folded(source, "user_id", "long", folds.Cache(3600 * S), "1 minute"), "t").collect()
    at, want = {}, {}
    for i, user, us, *_ in events:
        want[i] = user in at and us - at[user] < 3600 * S
        at[user] = at[user] if want[i] else us
    assert {r.event_id: r.hit for r in got} == want and len(got) == len(want)


def test_state_ends_with_its_timers():
    """What a fold remembers is dropped, so a key that stays away holds no state."""
    cache, memory = folds.Cache(10), {}
    assert cache.event(memory, {"us": 5, "event_id": 1}) == [(1, False)] and cache.next_timer(memory) == 15
    assert cache.timers(memory, 15) == [] and memory and cache.timers(memory, 16) == [] and not memory
    progress = folds.Progress(4, 10, ("error",))
    assert progress.event(memory, {"us": 0, "event_id": 1, "status": "run", "stage": 1})[0][1] == "frame"
    assert [r[:2] for r in progress.timers(memory, 100)] == [(4, "heartbeat"), (8, "heartbeat"), (10, "timeout")] and not memory


def test_updates(spark, tmp_path):
    rows = [(i, i % 3, 10 ** 15 + i * S, "s", i) for i in range(30)]
    source = stream(spark, str(tmp_path), [rows[10:20], rows[20:], rows[:10] + rows[25:]])
    last = source.groupBy("user_id").agg(F.max_by("stage", "us").alias("stage"))
    got = feeds.drained_updates(last, ["user_id"], "t").collect()
    assert {r.user_id: r.stage for r in got} == {0: 27, 1: 28, 2: 29}


@pytest.mark.parametrize("n", [0, 1])
def test_small_feeds(spark, n):
    events = spark.createDataFrame([(i, 1, 5 * S, "x", 1) for i in range(n)] + [(9, 1, None, "x", 1)], SCHEMA)
    source = feeds.feed(events, 3, close_after=10 * S)
    got = feeds.drained(folds.folded(source, "user_id", "long", folds.Cache(limits.SECOND), "1 second"), "t")
    assert got.count() == n


@pytest.mark.parametrize("packs", [1, 5])
def test_keys_share_states(spark, tmp_path, packs):
    """Few states for many keys, each key folded by itself; ids beyond 2^53 stay whole beside nulls."""
    rng, big = random.Random(4), 2 ** 60
    events, us = [], 10 ** 15
    for i in range(400):
        us += rng.choice([0, S, 40 * S])
        events.append((big + i, big + rng.randrange(30), us, rng.choice(["run", "wait", "error"]), rng.choice([big + 1, big + 2, None])))
    close = [(None, None, us + 10 ** 5 * S, None, None)]
    source = stream(spark, str(tmp_path), [events[:150], events[150:], close])
    made = folds.folded(source, "user_id", "long", folds.Progress(15 * S, 360 * S, ("error",)), "100 seconds", packs)
    query = made.writeStream.format("memory").queryName(f"shared{packs}").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(((r.user_id, r.at, r.kind, r.status, r.event_id) for r in spark.table(f"shared{packs}").collect()), key=repr)
    assert got == frames_brute(events, 15 * S, 360 * S, ("error",))
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= packs
