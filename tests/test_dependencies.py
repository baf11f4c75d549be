"""Dependencies with lockfiles, releases and flaws on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from codestrata.plans import dependencies as dep


@pytest.mark.parametrize("version,than,want", [
    ("1.2.3", "1.10.0", True), ("2.0", "2.0.0", False), ("2", "2.0.1", True), ("1.10", "1.9", False), ("unknown", "1", False), ("*", "1", False), (None, "1", False),
    ("1", None, False), ("1.0a1", "1.0", True), ("1.0a1", "1.0a1", False), ("1", "", False),
])
def test_older(spark, version, than, want):
    row = spark.createDataFrame([(version, than)], "a string, b string")
    assert row.select(dep.older(F.col("a"), F.col("b")).alias("x")).first().x is want


def test_enriched(spark):
    deps = [(1, "Flask_Login", "python", "unknown", None), (2, "flask", "python", "1.0", None), (3, "nopin", "python", "unknown", None),
            (4, "lodash", "node", "4.17.20", "^4.17.20"), (5, "left-pad", "node-dev", "1.3.0", "=v1.3.0"), (6, "react", "node", "18.0.0", ">=18"),
            (7, "x", "go", "1.0", None), (8, None, "python", "1.0", None)]
    locked = [("python", "flask.login", "0.6", 2), ("python", "flask-login", "0.5", 5), ("node", "lodash", "4.17.21", 1), ("python", "flask", "9.9", 1)]
    latest = [("flask", "1.1"), ("FLASK-LOGIN", "0.6"), ("nopin", "3.0"), ("lodash", "5.0.0")]
    flaws = [("python", "Flask", "1.0", "HIGH"), ("node", "lodash", "4.17.20", "critical"), ("node", "left-pad", "1.3.0", "Critical"), ("node", "left-pad", "1.3.0", None),
             ("node", "react", "18.0.0", "low")]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = dep.enriched(table(deps, "dep_id long, name string, type string, version string, spec string"), table(locked, "ecosystem string, name string, version string, seq long"),
                       table(latest, "name string, version string"), table(flaws, "ecosystem string, name string, version string, severity string"))
    rows = {r.dep_id: tuple(r)[3:] for r in got.collect()}
    assert rows == {
        1: ("0.6", "lockfile", "0.6", False, "ok", 0, "Low"), 2: ("1.0", None, "1.1", True, "ok", 1, "High"), 3: ("unknown", None, "3.0", False, "skipped", 0, "Low"),
        4: ("4.17.21", None, None, False, "ok", 0, "Low"), 5: ("1.3.0", None, None, False, "ok", 2, "Critical"), 6: ("18.0.0", None, None, False, "skipped", 0, "Low"),
        7: ("1.0", None, None, False, "skipped", 0, "Low"), 8: ("1.0", None, None, False, "ok", 0, "Low")}
    assert tuple(dep.tiles(got).first()) == (8, 1, 2, 7, 88)
    assert tuple(dep.tiles(got.limit(0)).first()) == (0, 0, 0, 0, 100)
