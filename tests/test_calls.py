"""Call resolution and refreshes against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from codestrata.plans import calls, incremental

DEFS = "def_id long, module long, class string, name string"
CALLS = "call_id long, module long, class string, name string, kind string"


def world():
    rng = random.Random(5)
    defs = [(i, rng.choice([1, 2, 3, None]), rng.choice([None, None, "A", "B"]), rng.choice(["f", "g", "h", "k", "only", None])) for i in range(30)]
    defs = [d for d in defs if d[3] != "only"] + [(90, 1, None, "only"), (91, 2, "A", "run")]
    sites = [(i, rng.choice([1, 2, 3, None]), rng.choice([None, "A", "B"]), rng.choice(["f", "g", "h", "k", "only", "run", "unknown", None]),
              rng.choice(["name", "self", "attr"])) for i in range(300)]
    return defs, sites


def targets(defs, site):
    _, module, cls, name, kind = site
    named = [d for d in defs if d[3] == name and name is not None]
    exact = [d[0] for d in named if d[1] == module and module is not None and (
        (kind == "name" and d[2] is None) or (kind == "self" and cls is not None and d[2] == cls))]
    return ({max(exact)}, True) if exact else ({d[0] for d in named}, False)


def test_resolve(spark):
    defs, sites = world()
    d, c = spark.createDataFrame(defs, DEFS), spark.createDataFrame(sites, CALLS)
    got = {r.call_id: r for r in calls.resolve(c, d).collect()}
    once = {r.call_id: r.target for r in calls.resolve_unique(c, d).collect()}
    for site in sites:
        want, exact = targets(defs, site)
        r = got[site[0]]
        assert r.n_targets == len(want) and r.target == (next(iter(want)) if len(want) == 1 else None), site
        assert r.how == ({"name": "module", "self": "class"}[site[4]] if exact else "name" if want else "none")
        tops = {}
        for i, m, cls, name in defs:
            if cls is None and name == site[3] and name is not None:
                tops[m] = max(i, tops.get(m, i))
        alone = next(iter(tops.values())) if len(tops) == 1 and site[4] == "name" else None
        assert once[site[0]] == (next(iter(want)) if exact else alone), site
    left = {r.def_id for r in calls.unreferenced(d, c.filter("call_id < 12"), F.col("name") == "k").collect()}
    used = set().union(*(targets(defs, s)[0] for s in sites if s[0] < 12))
    assert left == {i for i, _, _, name in defs if i not in used and name != "k"}


@pytest.mark.parametrize("changes", [[], [3, 4], list(range(60)), [1000, 7]])
def test_refresh(spark, tmp_path, changes):
    """A refreshed store equals a new one; files may change, come and go, whole buckets too."""
    path = str(tmp_path / "store")
    old = {i: i for i in range(50)}
    new = {i: (i * 10 if i in changes else v) for i, v in old.items() if not (i in changes and i % 3 == 0)} | {i: 5 for i in changes if i > 50}
    table = lambda rows: spark.createDataFrame(list(rows.items()), "file long, v long")
    incremental.create(table(old), path)
    changed = spark.createDataFrame([(i,) for i in [*changes, *changes[:1], None]], "file long")
    for _ in range(2):
        incremental.refresh(path, changed, table(new | {2: 77} if 2 not in changes else new))
        assert {r.file: r.v for r in incremental.read(spark, path).collect()} == new
    assert incremental.read(spark, path).count() == len(new)
