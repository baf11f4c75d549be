"""Scores and state queries on hand-made tables, also empty ones."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codestrata.catalog import activity
from codestrata.plans import batches, cohesion, scores

FACTS = """file long, role string, file_type string, max_cc long, max_depth long, recursive boolean, n_lines long,
critical long, high long, medium long, low long, info long, unknown long, n_structural long, doc_tenths long, cc_tenths long"""


def facts(spark, *rows):
    return spark.createDataFrame(list(rows), FACTS)


@pytest.mark.parametrize("kind,cc,depth,found,want", [
    ("production", 1, 0, {}, 100),      # nothing to find
    ("production", 5, 0, {}, 98),       # 2 ** 1.3 is 2.46, so two points
    ("production", 25, 3, {}, 100 - 12 - 35),   # complexity costs 35 at most
    ("production", 1, 0, {"critical": 9}, 0),   # never under 0
    ("production", 1, 0, {"low": 2}, 98),       # each severity has its points
    ("production", 1, 0, {"info": 5}, 100),
    ("production", 1, 0, {"unknown": 2}, 94),
    ("production", 1, 0, {"high": 1, "medium": 1, "low": 1}, 87),
    ("test", 25, 3, {"critical": 9}, 75),       # test files never under 75
    ("test", 1, 0, {"medium": 9, "unknown": 3}, 100),   # and only the worst severities count there
])
def test_score(spark, kind, cc, depth, found, want):
    severities = [found.get(k, 0) for k in ("critical", "high", "medium", "low", "info", "unknown")]
    row = (1, "utility", kind, cc, depth, False, 10, *severities, 0, 1000, 10)
    got = scores.scored(facts(spark, row)).first()
    assert got["score"] == want
    assert max(75 if kind == "test" else 0, 100 + got["heuristics"] + got["security"] + got["complexity"]) == want


def functions_brute(rows):
    held = {}
    for m, f, i in rows:
        if m is not None and f is not None:
            held.setdefault(m, {}).setdefault(f, set()).update([i] if i is not None else [])
    out = {}
    for m, fs in held.items():
        sets = list(fs.values())
        pairs = len(sets) * (len(sets) - 1) // 2
        joined = sum(bool(a & b) for k, a in enumerate(sets) for b in sets[:k])
        out[m] = (len(sets), pairs, joined, joined / pairs if pairs else 1.0)
    return out


def test_cohesion(spark):
    """A hot module in which common identifiers connect most, rare ones more than can be bits, and small modules."""
    rng = random.Random(9)
    rows = [("hot", f"f{k}", f"i{int(rng.expovariate(.15))}") for k in range(150) for _ in range(rng.randrange(4))]
    rows += [("flat", f"f{k % 40}", f"i{k % 37}") for k in range(120)] + [("one", "f", "x"), ("none", "f", None), ("none", "g", None), ("two", "f", "x"), ("two", "g", "x")]
    rows += rows[:20] + [(None, "f", "x"), ("two", None, "x")]
    got = cohesion.modules(spark.createDataFrame(rows, "module string, function string, identifier string")).collect()
    assert {r.module: tuple(r)[1:] for r in got} == functions_brute(rows)


def test_cohesion_of_many_modules(spark):
    """Small modules are counted together, in tables that never part one; arrays count as their items."""
    rng = random.Random(3)
    rows = [(m, f"f{rng.randrange(6)}", [rng.choice([None, *"abcdefgh"]) for _ in range(rng.randrange(4))]) for m in range(400) for _ in range(rng.randrange(1, 12))]
    rows += [(1, "big", [f"i{k}" for k in range(cohesion.SMALL)]), (1, "near", ["i7"]), (2, "f0", None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = cohesion.modules(spark.createDataFrame(rows, "module long, function string, identifiers array<string>")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.module: tuple(r)[1:] for r in got} == functions_brute([(m, f, i) for m, f, ids in rows for i in ids or [None]]
                                                                    + [(m, f, None) for m, f, _ in rows])


@pytest.mark.parametrize("sizes", [[], [1], [3, 1, 50, 2, 20, 1, 1]])
def test_whole_keys(spark, sizes):
    """Every table holds whole keys, also of keys that are longer than a batch."""
    rows = spark.createDataFrame([(k, i) for k, n in enumerate(sizes) for i in range(n)], "k long, i long")

    def count(table):
        of = table.group_by("k").aggregate([("i", "count")])
        return pa.table({"k": of["k"], "n": of["i_count"]})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = batches.by_key(rows, "k", count, "k long, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == list(enumerate(sizes))


@pytest.mark.parametrize("n", [0, 1, 5, 60])
def test_disjoint_pairs(n):
    rng = np.random.default_rng(n)
    bits, counts = np.unique(rng.integers(0, 1 << cohesion.HEAVY, n) & rng.integers(0, 1 << cohesion.HEAVY, n), return_counts=True)
    each = np.repeat(bits, counts).tolist()
    assert cohesion.disjoint_pairs(bits, counts) == sum(a & b == 0 for k, a in enumerate(each) for b in each[:k])


def test_files_without_functions(spark, tmp_path):
    """They have the complexity of their own code and count in every average."""
    day = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, "1-URGENT"), (2, "1-URGENT")], "o_orderkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, 5, 7, 1, 24.0, 100.0, 0.0, 0.0, "R", "F", day)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                          "l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
                          ).write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = {r.file: r for r in scores.file_facts(spark, str(tmp_path)).collect()}
    assert (rows[2].max_cc, rows[2].cc_tenths, rows[2].max_depth, rows[2].n_lines, rows[2].doc_tenths) == (1, 10, 0, 0, 0)
    got = scores.summary(scores.scored(scores.file_facts(spark, str(tmp_path)))).first()
    assert (got.n_files, got.n_production, got.avg_cc, got.avg_doc) == (2, 2, 13.0, 50.0)


def test_tasks_of_chosen_files_have_few_rows(spark, monkeypatch):
    """The number of tasks follows the number of rows, and the facts are those of the chosen files."""
    monkeypatch.setattr(scores, "TASK_ROWS", 500)
    sf = "/root/testdata/sf0.001"
    some = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("file")).filter("file % 3 = 0")
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500 + 1
    got = scores.file_facts(spark, sf, some)
    assert f", {n}), REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    want = scores.file_facts(spark, sf).filter("file % 3 = 0")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_summary_without_files(spark):
    got = scores.summary(scores.scored(facts(spark))).first()
    assert (got["n_files"], got["avg_score"], got["security_score"], got["simplicity_score"]) == (0, 0.0, 100, 100)


@pytest.fixture
def events(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, 23, 59, 30)
    rows = [(0, start, 1, "view"), (1, start + dt.timedelta(seconds=59), 1, "view"),
            (2, start + dt.timedelta(seconds=60), 1, "click"), (3, start + dt.timedelta(days=3), 1, "click"),
            (4, start, 2, "error"), (5, start + dt.timedelta(seconds=150), 2, "click"), (6, start, 3, "error")]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    table.write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_trailing_counts_over_minutes(spark, events):
    got = {r.event_id: r.n for r in activity.trailing_counts(spark, events).collect()}
    assert [got[i] for i in range(4)] == [1, 2, 2, 1]


def test_changes_over_days(spark, events):
    got = sorted(r.event_id for r in activity.progress_changes(spark, events).filter("user_id = 1").collect())
    assert got == [0, 2]


def test_labels_match_within_two_lines(spark, events):
    got = {r.event_id: r.hit for r in activity.label_matches(spark, events).collect()}
    assert got == {4: False, 6: False}      # 23:59 and 00:02 are three lines apart
