"""Graph loops against plain searches on random graphs, chains, self loops and empty tables."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from codestrata.plans import graphs


def table(spark, edges):
    return spark.createDataFrame(edges, "u long, v long")


def reach(edges):
    out = {}
    for u, v in edges:
        out.setdefault(u, set()).add(v)
    found = {}
    for s in {n for e in edges for n in e}:
        seen, todo = set(), [s]
        while todo:
            for v in out.get(todo.pop(), ()):
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        found[s] = seen
    return found


GRAPHS = {
    "random": lambda r: [(r.randrange(40), r.randrange(40)) for _ in range(52)],
    "dense": lambda r: [(r.randrange(12), r.randrange(12)) for _ in range(60)],
    "rings": lambda r: [(10 * k + i, 10 * k + (i + 1) % 5) for k in range(4) for i in range(5)] + [(0, 10), (10, 20), (33, 20), (99, 0), (30, 98)],
    "chain": lambda r: [(i, i + 1) for i in range(9)],
    "self": lambda r: [(1, 1), (2, 2), (2, 3), (4, 5), (5, 4), (5, 5)],
    "hub": lambda r: [(0, i) for i in range(1, 60)] + [(i, 0) for i in range(1, 60, 7)],
    "empty": lambda r: [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_cycles_and_parts(spark, name):
    edges = GRAPHS[name](random.Random(7))
    r = reach(edges)
    want = {n: max(m for m in r[n] if n in r[m]) for n in r if n in r[n]}
    got = graphs.cycles(table(spark, edges + edges[:3] + [(None, 1), (1, None)])).collect()
    assert {x.node: x.component for x in got} == want and len(got) == len(want)
    both = reach(edges + [(v, u) for u, v in edges])
    got = graphs.connected(table(spark, edges + [(None, 1)])).collect()
    assert {x.node: x.component for x in got} == {n: min({n} | both[n]) for n in both} and len(got) == len(both)


@pytest.mark.parametrize("name", ["random", "rings", "chain", "empty"])
def test_reached(spark, name):
    edges = GRAPHS[name](random.Random(3))
    seeds = [(0, 2), (0, 1), (33, 3), (77, 1)]
    hops, tier, out = {}, {}, reach(edges)
    todo = deque((n, 0) for n, _ in seeds)
    while todo:
        n, h = todo.popleft()
        if n not in hops:
            hops[n] = h
            todo.extend((v, h + 1) for u, v in edges if u == n)
    for s, t in seeds:
        for n in {s} | out.get(s, set()):
            tier[n] = max(t, tier.get(n, 0))
    got = graphs.reached(spark.createDataFrame(seeds, "node long, tier int"), table(spark, edges)).collect()
    assert {r.node: (r.hops, r.tier) for r in got} == {n: (hops[n], tier[n]) for n in hops}


def test_unused(spark):
    nodes = spark.createDataFrame([(i, "x") for i in range(5)], "node long, name string")
    got = graphs.unused(nodes, table(spark, [(0, 1), (2, 2)]), nodes.filter("node = 3"))
    assert sorted(r.node for r in got.collect()) == [0, 4]


def test_reached_reads_its_edges_once(spark):
    """The rounds work on a table and don't make the edges again."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(u):
        made.add(1)
        return True

    edges = [(i, i + 1) for i in range(8)]
    got = graphs.reached(spark.createDataFrame([(0, 1)], "node long, tier int"), table(spark, edges).filter(seen("u"))).collect()
    assert len(got) == 9 and made.value == len(edges)


def test_connected_sends_no_labels_to_the_driver(spark, monkeypatch):
    plans, write = [], graphs.materialize

    def note(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(graphs, "materialize", note)
    assert len(graphs.connected(table(spark, GRAPHS["chain"](None))).collect()) == 10
    assert "SortMergeJoin" in "".join(plans) and "Broadcast" not in "".join(plans)


@pytest.mark.parametrize("name", GRAPHS)
def test_cycles_by_rounds(spark, monkeypatch, name):
    """Parts too large for a task give the same."""
    monkeypatch.setattr(graphs, "WITHIN", 3)
    test_cycles_and_parts(spark, name)


@pytest.mark.parametrize("name", ["random", "rings", "self"])
def test_small_parts_need_no_rounds(spark, monkeypatch, name):
    """Rounds depend on the longest path; parts that fit a task are searched without any, some to each task."""
    made, write = [], graphs.materialize

    def note(df, label):
        made.append(label)
        return write(df, label)

    monkeypatch.setattr(graphs, "materialize", note)
    monkeypatch.setattr(graphs, "PACK", 4, raising=False)
    test_cycles_and_parts(spark, name)
    assert not {"trimmed", "spread", "coloured"} & set(made)


def test_long_ways_need_few_rounds(spark, monkeypatch):
    """A ring and a chain that lead through one node after the other, too long for a task, shrink by a part in each round."""
    made, write = [], graphs.materialize

    def note(df, label):
        made.append(label)
        assert len(made) < 100, "a round for each step"
        return write(df, label)

    monkeypatch.setattr(graphs, "materialize", note)
    monkeypatch.setattr(graphs, "WITHIN", 100)
    ring = [(i, (i + 1) % 500) for i in range(500)] + [(600 + i, 601 + i) for i in range(300)] + [(3, 600), (900, 2000), (2000, 2001), (2001, 2000)]
    got = {r.node: r.component for r in graphs.cycles(table(spark, ring)).collect()}
    assert got == {i: 499 for i in range(500)} | {2000: 2001, 2001: 2001}


def test_large_core_goes_by_its_busiest_node(spark, monkeypatch):
    """A core without nodes to merge, larger than a task may have, and two more beside and behind it."""
    r, made, write = random.Random(5), [], graphs.materialize

    def note(df, label):
        made.append(label)
        return write(df, label)

    monkeypatch.setattr(graphs, "materialize", note)
    monkeypatch.setattr(graphs, "WITHIN", 60)
    edges = [(b + i, b + (i * k + k) % n) for b, n in ((0, 60), (100, 9), (200, 7)) for i in range(n) for k in (1, 2, 4)] + [(5, 100), (7, 104)]
    edges += [(300 + r.randrange(90), 300 + r.randrange(90)) for _ in range(120)]
    way = reach(edges)
    want = {n: max(m for m in way[n] if n in way[m]) for n in way if n in way[n]}
    got = graphs.cycles(table(spark, edges)).collect()
    assert {x.node: x.component for x in got} == want and len(got) == len(want)
    assert "parted" in made and "coloured" not in made
