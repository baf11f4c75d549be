"""Method groups, frameworks and layers on hand-made classes and modules."""

import random

from codestrata.plans import architecture as arch


def groups_brute(rows):
    methods = {}
    for c, m, a in rows:
        if c is not None and m is not None:
            methods.setdefault(c, {}).setdefault(m, set()).update([a] if a is not None else [])
    out = {}
    for c, ms in methods.items():
        parts = []
        for m, attrs in ms.items():
            near = [p for p in parts if p[1] & attrs]
            parts = [p for p in parts if p not in near] + [({m}.union(*(p[0] for p in near)), attrs.union(*(p[1] for p in near)))]
        out[c] = (len(ms), len(parts))
    return out


def test_method_groups(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(6), rng.randrange(20), rng.choice([None, *range(15)])) for _ in range(150)]
    rows += [(50, k, k // 2) for k in range(30)] + [(50, k, (k + 1) // 2) for k in range(30)] + [(None, 1, 1), (7, None, 1), (8, 1, None)]
    got = arch.method_groups(spark.createDataFrame(rows, "class long, method long, attribute long"))
    assert {r["class"]: (r.n_methods, r.groups) for r in got.collect()} == groups_brute(rows)


def test_small_and_large_classes(spark, monkeypatch):
    """Classes that are grouped together and one that is not, chains of shared attributes among them."""
    monkeypatch.setattr(arch, "SMALL", 60)
    rng = random.Random(4)
    rows = [(c, rng.randrange(9), rng.choice([None, *range(12)])) for c in range(300) for _ in range(rng.randrange(1, 9))]
    rows += [(c, order[k], order[k + j]) for c, n in ((500, 25), (501, 90)) for order in [rng.sample(range(n + 1), n + 1)] for k in range(n) for j in (0, 1)]
    got = arch.method_groups(spark.createDataFrame(rows, "class long, method long, attribute long")).collect()
    assert {r["class"]: (r.n_methods, r.groups) for r in got} == groups_brute(rows) and len(got) == len({r[0] for r in rows})


def test_god_objects(spark):
    rows = [(1, 25, 1), (2, 24, 2), (3, 12, 3), (4, 11, 11), (5, 2, 2)]
    got = arch.god_objects(spark.createDataFrame(rows, "class long, n_methods long, groups long")).collect()
    assert {r["class"]: r.reason for r in got} == {1: "very large", 3: "unrelated groups"}


def test_frameworks(spark):
    imports = [(1, "flask"), (1, "flask.views"), (2, "flaskx"), (3, "django.db.models"), (4, "django"), (5, None), (6, "fastapi")]
    got = arch.detected(spark.createDataFrame(imports, "file long, name string"),
                        {"web": {"flask": ("flask",), "django": ("django",), "fastapi": ("fastapi",)}, "orm": {"django-orm": ("django.db",)}})
    assert {(r.category, r.framework): (r.n_files, r.confidence) for r in got.collect()} == {
        ("web", "flask"): (1, .6), ("web", "django"): (2, .7), ("web", "fastapi"): (1, .6), ("orm", "django-orm"): (1, .6)}
    assert {(r.category, r.framework) for r in arch.primary(got).collect()} == {("web", "django"), ("orm", "django-orm")}


def test_layers(spark):
    rows = [("app.models.user", "app.api.routes", 3), ("app.api.x", "app.models.user", 4), ("app.service.a", "app.services.b", 1),
            ("app.models.views", "app.store", 5), ("app.util", "app.api", 2), ("app.dao", "x::engine", 9)]
    got = arch.layer_violations(spark.createDataFrame(rows, "importer string, importee string, line int"))
    assert {(r.importer, r.line, r.importer_layer, r.importee_layer) for r in got.collect()} == {
        ("app.models.user", 3, "model", "api"), ("app.models.views", 5, "model", "repository"), ("app.dao", 9, "repository", "service")}
