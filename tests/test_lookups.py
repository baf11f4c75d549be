"""Nearest neighbours, prefixes and trees against plain loops."""

import functools

import numpy as np
import pytest

from codestrata.plans import neighbours, paths


@pytest.mark.parametrize("cells,slice_", [(1 << 21, 16 << 20), (7, 300)])
def test_nearest(spark, monkeypatch, cells, slice_):
    monkeypatch.setattr(neighbours, "CELLS", cells)
    monkeypatch.setattr(neighbours, "SLICE", slice_)
    rng = np.random.default_rng(3)
    base = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(120)]         # many ties
    base += [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0]), (203, [float("nan")] * 4), (None, [1.0] * 4), (204, [1.0, 2.0]), (3, [0.0] * 4)]
    queries = [(i, v) for i, v in base if i is not None and i % 7 == 0] + [(202, base[122][1]), (204, [1.0, 2.0]), (999, [0.0] * 4), (998, [1.0] * 9), (997, None)]
    got = neighbours.nearest(spark.createDataFrame(base, "id long, vector array<double>").repartition(3),
                             spark.createDataFrame(queries, "id long, vector array<double>"), 3).collect()
    good = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)
    want = []
    for q, v in queries:
        if good(v):
            u = np.array(v) / (np.linalg.norm(v) or 1)
            far = sorted((float(((np.array(w) - u) ** 2).sum()), i) for i, w in base if i is not None and good(w) and len(w) == len(v))
            want += [(q, r + 1, round(d, 9), i) for r, (d, i) in enumerate(far[:3])]
    have = sorted((r.query, r["rank"], round(r.distance, 9), r.id) for r in got)
    assert have == sorted(want)


def test_longest_prefix(spark):
    known = ["pkg", "pkg.core", "pkg.core.engine.deep", "other"]
    names = ["pkg.core.Engine", "pkg.corex.A", "pkg", "pk", "pkg.core.engine", "other", "", None, "pkg.core.engine.deep.er", "pkg.core.Engine"]
    got = {r.name: r.module for r in paths.longest_prefix(spark.createDataFrame([(n,) for n in names], "name string"),
                                                          spark.createDataFrame([(k,) for k in known * 2], "module string")).collect()}
    assert got == {"pkg.core.Engine": "pkg.core", "pkg.corex.A": "pkg", "pkg": "pkg", "pk": None, "pkg.core.engine": "pkg.core",
                   "other": "other", "": None, "pkg.core.engine.deep.er": "pkg.core.engine.deep"}


def test_tree(spark):
    files = ["src/b.py", "src/A/z.py", "src/a/x.py", "README", "src\\a\\y.py", "zoo/k", "a.txt", "/src//b.py", "", "zoo", "src/a/B/c", None]
    got = paths.tree_order(spark.createDataFrame([(f,) for f in files], "path string")).orderBy("position").collect()
    rows = set()
    for f in files:
        p = tuple(x for x in (f or "").replace("\\", "/").split("/") if x)
        rows |= {(p[:n], n < len(p)) for n in range(1, len(p) + 1)}

    def before(a, b):
        for k in range(min(len(a[0]), len(b[0]))):
            x, y = ((not (d or k < len(p) - 1), p[k].lower(), p[k]) for p, d in (a, b))
            if x != y:
                return -1 if x < y else 1
        return len(a[0]) - len(b[0])

    want = sorted(rows, key=functools.cmp_to_key(before))
    assert [(r.path, r.kind) for r in got] == [("/".join(p), "dir" if d else "file") for p, d in want]
    assert [r.position for r in got] == list(range(1, len(want) + 1))
