"""Rate limits, running totals and bindings against plain loops, with ties, nulls, hot keys and empty tables."""

import random

import pytest

from codestrata.plans import limits, scopes, sequence

S = limits.SECOND


def limited_brute(hits, limit, window):
    held, out = {}, {}
    for bucket, client, us, i in sorted((h for h in hits if h[2] is not None), key=lambda h: (h[2], h[3])):
        live = [t for t in held.get((bucket, client), []) if us - t < window]
        if len(live) >= limit:
            out[i] = (False, max(1, int((window - (us - min(live))) / S) + 1))
        else:
            live.append(us)
            out[i] = (True, None)
        held[bucket, client] = live
    return out


@pytest.mark.parametrize("limit,window,every", [(1, 60 * S, 20 * S), (3, 60 * S, 15 * S), (5, 60 * S, 400 * S), (2, 10, 3), (60, 60 * S, S // 2)])
def test_rate_limits(spark, limit, window, every):
    rng = random.Random(limit)
    hits, at = [], {}
    for i in range(1500):
        key = (rng.choice(["scan", "list", None]), rng.choice([1, 1, 1, 1, 2, None]))
        # bursts, quiet times longer than a window, and hits at the very same time
        at[key] = at.get(key, 10 ** 12) + rng.choice([0, 1, every, every, every, (4 * window, window)[i % 2] if rng.random() < .05 else 0])
        hits.append((*key, at[key], i))
    hits += [("scan", 1, None, 5000)]
    got = limits.rate_limited(spark.createDataFrame(hits, "bucket string, client long, us long, hit_id long"), limit, window).collect()
    want = limited_brute(hits, limit, window)
    assert {r.hit_id: (r.accepted, r.retry_after) for r in got} == want and len(got) == len(want)
    assert limit == 5 or any(not a for a, _ in want.values())


def test_rate_limits_empty(spark):
    assert limits.rate_limited(spark.createDataFrame([], "bucket string, client long, us long, hit_id long"), 2, S).collect() == []


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_as_of(spark, width):
    rng = random.Random(width)
    facts = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *range(60)]), rng.choice([None, *range(100, 140)])) for _ in range(300)]
    asks = [(i, rng.choice(["a", "a", "b", "c", None]), rng.choice([None, *range(-2, 63)])) for i in range(300)]
    got = sequence.as_of(spark.createDataFrame(asks, "i long, k string, at long"), spark.createDataFrame(facts, "k string, at long, v long"),
                         ["k"], "at", "v", width)
    for i, k, at, v in got.select("i", "k", "at", "v").collect():
        earlier = [(fa, fv) for fk, fa, fv in facts if fk == k and fa is not None and fv is not None and at is not None and fa < at]
        assert v == (max(earlier)[1] if earlier else None), (k, at)
    assert got.count() == len(asks)


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(20), rng.randrange(100)) for i in range(500)]
    got = sequence.running_totals(spark.createDataFrame(rows, "key long, at long, bytes long"), ["at", "key"], "bytes", "t").collect()
    total, want = 0, {}
    for i, _, n in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = total
        total += n
    assert {r.key: r.before for r in got} == want


@pytest.mark.parametrize("cap", [0, 700, 10 ** 6])
def test_eviction(spark, cap):
    rows = [(1, 5, 100), (2, None, 200), (3, 5, 300), (4, 1, None), (5, 9, 400), (6, 0, 50)]
    total, want = sum(n or 0 for _, _, n in rows), {5: False}
    for key, _, n in sorted((r for r in rows if r[0] != 5), key=lambda r: (-1 if r[1] is None else r[1], r[0])):
        want[key] = total > cap
        total -= (n or 0) if want[key] else 0
    df = spark.createDataFrame(rows, "key long, used_at long, bytes long")
    got = sequence.evicted(df, cap, df["key"] == 5).collect()
    assert {r.key: r.evicted for r in got} == want
    assert sequence.evicted(df.limit(0), cap, df["key"] == 5).collect() == []


def test_scopes(spark):
    """A class is looked into only from itself; a line itself is not before; outer scopes come later."""
    tree = spark.createDataFrame([(0, None, "module"), (1, 0, "class"), (2, 1, "function"), (3, 2, "lambda"), (9, 9, "function")],
                                 "scope long, parent long, kind string")
    got = {(r.scope, r.seen, r.distance) for r in scopes.chains(tree).collect()}
    assert got == {(0, 0, 0), (1, 1, 0), (1, 0, 1), (2, 2, 0), (2, 0, 2), (3, 3, 0), (3, 2, 1), (3, 0, 3), (9, 9, 0)}
    binds = spark.createDataFrame([(0, "x", 1, 10), (1, "x", 2, 11), (2, "x", 5, 12), (2, "x", 5, 13), (2, "x", 8, 14)],
                                  "scope long, name string, line long, binding long")
    uses = spark.createDataFrame([(1, 3, "x", 5), (2, 3, "x", 6), (3, 1, "x", 3), (4, 3, "x", 1), (5, 3, "y", 9), (6, 3, "x", None)],
                                 "event_id long, scope long, name string, line long")
    got = {r.event_id: (r.binding, r.distance) for r in scopes.resolve(uses, binds, tree, 4).collect()}
    assert got == {1: (10, 3), 2: (13, 1), 3: (11, 0), 4: (None, None), 5: (None, None), 6: (None, None)}
