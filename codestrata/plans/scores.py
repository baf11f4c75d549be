"""Complexity, issues and scores of files, a file being an order and its line items the functions in it.

Every figure comes from one aggregation by file; ratios are rounded half to even in
whole numbers, so that no result hangs on the order in which parts are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import read_table

# Complexity from which a role warns and errs.
THRESHOLDS = {"orchestrator": (25, 40), "cli_parser": (18, 30), "utility": (10, 20), "data_model": (12, 22), "test": (5, 10)}
# Points that a finding of each severity costs.
SEVERITY_POINTS = {"critical": 12, "high": 8, "medium": 4, "low": 1, "info": 0, "unknown": 3}
# Hundredths that a file of each type weighs in the average score.
TYPE_WEIGHTS = {"production": 100, "example": 10, "docs": 5, "test": 0}
# Hundredths of a discount that stand for a security finding of a severity; a tax of OTHER for one of another kind.
SEVERITIES = {10: "critical", 9: "high", 8: "medium", 7: "low", 6: "info", 5: "unknown"}
OTHER = 8
# Lines from which a file is long, and the share of connected functions under which it is split up.
LONG, SPLIT = 500, 0.40
TASK_ROWS = 500_000     # functions in a task where files are chosen, about
# Which role and type an order's priority stands for.
ROLES = {"1": "orchestrator", "2": "cli_parser", "3": "utility", "4": "data_model", "5": "test"}
TYPES = {"1": "production", "2": "production", "3": "example", "4": "docs", "5": "test"}


def pick(key: Column, table: dict, otherwise=None) -> Column:
    """The table's value for a key, as a chain of conditions."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(otherwise)


def half_even(total: Column, n: Column) -> Column:
    """total / n in whole numbers, ties to the even one; both not negative, null where n is 0."""
    n = F.nullif(n, F.lit(0))
    rest = F.pmod(total, n)
    whole = F.floor((total - rest) / n).cast("long")
    up = (2 * rest > n) | ((2 * rest == n) & (whole % 2 == 1))
    return whole + up.cast("long")


def file_facts(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """One row per file, or per file of ``only``: complexity, depth, findings, documentation, lines, role and type.

    A file without functions has the complexity 1 of its own code, and none of anything else.
    """
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    items = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file"), F.col("l_quantity").cast("long").alias("quantity"),
        (F.col("l_returnflag") == "R").alias("recursive"), (F.col("l_returnflag") != "N").cast("long").alias("documented"),
        (F.floor("l_extendedprice") % 4).alias("depth"), cents("l_discount").alias("severity"), cents("l_tax").alias("other"))
    if only is not None:
        # tasks of so many rows at every size, as a join sorts what a task gets
        parts = items.count() // TASK_ROWS + 1
        items = items.repartition(parts, "file").join(only.select("file").hint("merge"), "file", "left_semi")
    cc = F.col("quantity") % 25 + 1
    per_file = items.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_functions"), F.sum(cc).alias("cc_sum"), F.max(cc).alias("max_cc"),
        F.max("depth").alias("max_depth"), F.max("recursive").alias("recursive"),
        F.sum(4 * F.col("quantity")).alias("n_lines"), F.sum("documented").alias("documented"),
        *[F.count_if(F.col("severity") == k).alias(name) for k, name in SEVERITIES.items()],
        F.count_if(F.col("other") == OTHER).alias("n_structural"))
    first = F.substring("o_orderpriority", 1, 1)
    files = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("file"), pick(first, ROLES, "utility").alias("role"), pick(first, TYPES, "production").alias("file_type"))
    if only is not None:
        files = files.join(only.select("file"), "file", "left_semi")
    none = {c: 0 for c in ("n_functions", "max_depth", "n_lines", "documented", "n_structural", *SEVERITY_POINTS)}
    facts = files.join(per_file, "file", "left").na.fill(none | {"max_cc": 1, "recursive": False})
    return (
        facts.withColumn("cc_tenths", F.coalesce(half_even(10 * F.col("cc_sum"), F.col("n_functions")), F.lit(10)))
        .withColumn("doc_tenths", F.coalesce(half_even(1000 * F.col("documented"), F.col("n_functions")), F.lit(0))))


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module, function, identifiers): what the functions of a file touch: a supplier, a flag pair and a size."""
    lines = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("module"), F.concat_ws(".", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("function"),
        F.array(
            F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("f"), "l_returnflag", "l_linestatus"),
            F.concat(F.lit("q"), F.col("l_quantity").cast("long").cast("string"))).alias("identifiers"))
    return lines


def warnings(facts: DataFrame, cohesion: DataFrame) -> DataFrame:
    """(file, type, severity, n): production files that are long and hang together loosely, or have a complex function."""
    rows = facts.filter("file_type = 'production'").join(cohesion.select(F.col("module").alias("file"), "cohesion"), "file", "left")
    loose = F.coalesce("cohesion", F.lit(1.0)) < SPLIT
    found = F.array(
        F.when((F.col("n_lines") > LONG) & loose, F.struct(F.lit("long_file").alias("type"), F.lit("medium").alias("severity"), F.col("n_lines").cast("long").alias("n"))),
        F.when(F.col("max_cc") > 10, F.struct(F.lit("complex_function").alias("type"), F.when(F.col("max_cc") <= 20, "medium").otherwise("high").alias("severity"),
                                              F.col("max_cc").cast("long").alias("n"))))
    return rows.select("file", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("w")).select("file", "w.*")


def risk(facts: DataFrame) -> DataFrame:
    """Risk level by the thresholds of the file's role, and whether the file is a hotspot."""
    warn = pick(F.col("role"), {k: v[0] for k, v in THRESHOLDS.items()}, THRESHOLDS["utility"][0])
    err = pick(F.col("role"), {k: v[1] for k, v in THRESHOLDS.items()}, THRESHOLDS["utility"][1])
    level = F.when(F.col("max_cc") >= err, "error").when(F.col("max_cc") >= warn, "warning").otherwise("ok")
    return facts.withColumn("risk_level", level).withColumn(
        "hotspot", (F.col("max_cc") >= err) | (F.col("max_depth") >= 3) | F.col("recursive"))


def probability(facts: DataFrame) -> DataFrame:
    """Issue probability in hundredths, from complexity, loop depth, critical findings and length."""
    cc, depth = F.col("max_cc"), F.col("max_depth")
    parts = (F.when(cc > 10, 30).when(cc > 5, 10).otherwise(0)
             + F.when(depth >= 3, 30).when(depth == 2, 15).otherwise(0)
             + F.least(F.col("critical") * 20, F.lit(40)) + F.when(F.col("n_lines") > 500, 10).otherwise(0))
    return facts.withColumn("p", F.least(parts, F.lit(100)).cast("long"))


def scored(facts: DataFrame) -> DataFrame:
    """Quality score from 0 to 100 with its parts heuristics, security and complexity; test files by the lighter rule.

    n_security counts the security findings of all severities, n_issues those and the structural ones.
    """
    cc, depth, p = F.col("max_cc"), F.col("max_depth"), F.col("p")
    n_security = sum((F.col(k) for k in SEVERITY_POINTS), F.lit(0))
    heavy = 5 * (F.col("critical") + F.col("high"))
    drop = F.when(cc > 3, F.floor(F.pow((cc - 3).cast("double"), 1.3))).otherwise(0)
    drop = F.least(drop + F.when(depth == 2, 5).when(depth >= 3, 15).otherwise(0), F.lit(35))
    points = sum((F.col(k) * v for k, v in SEVERITY_POINTS.items()), F.lit(0))
    guess = F.floor(p * F.when(F.col("test"), 15).otherwise(20) / 100)
    out = probability(facts).withColumn("test", F.col("file_type") == "test").withColumn("n_security", n_security.cast("long"))
    out = out.withColumns({
        "n_issues": F.col("n_security") + F.col("n_structural"), "guess": guess,
        "cost": F.when(F.col("test"), heavy).otherwise(points), "drop": F.when(F.col("test"), 0).otherwise(drop)})
    plain = 100 - F.col("guess") - F.col("drop") - F.col("cost")
    clean = ~F.col("test") & (F.col("n_security") == 0) & (cc <= 5) & (depth <= 1) & (p < 60) & (plain < 95)
    out = out.withColumn("plain", plain).withColumn("bonus", F.when(clean, F.least(95 - plain, F.lit(15))).otherwise(0))
    score = F.greatest(F.when(F.col("test"), 75).otherwise(0), F.least(F.col("plain") + F.col("bonus"), F.lit(100)))
    half = F.floor(F.col("bonus") / 2)
    out = out.withColumns({
        "score": score.cast("long"), "heuristics": (half - F.col("guess")).cast("long"), "security": (-F.col("cost")).cast("long"),
        "complexity": (half - F.col("drop")).cast("long")})
    return out.drop("test", "guess", "cost", "drop", "plain", "bonus")


def verdict(score: Column) -> Column:
    return (F.when(score >= 90, "Excellent").when(score >= 80, "Healthy").when(score >= 60, "Fair")
            .when(score >= 40, "Needs attention").otherwise("At risk"))


def summary(files: DataFrame) -> DataFrame:
    """One row: weighted average score, documentation and complexity of production files, health."""
    weight = pick(F.col("file_type"), TYPE_WEIGHTS, 100)
    production = F.col("file_type") == "production"
    sums = files.agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(production).alias("n_production"),
        F.count_if(F.col("n_structural") > 0).alias("files_with_issues"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("lines_of_code"),
        F.coalesce(F.sum(F.when(production, F.col("n_security"))), F.lit(0)).alias("security_issues"),
        F.sum(F.col("score") * weight).alias("weighted"), F.sum(weight).alias("weights"),
        F.sum(F.when(production, F.col("doc_tenths"))).alias("docs"), F.sum(F.when(production, F.col("cc_tenths"))).alias("ccs"))
    some = F.col("n_production") > 0
    score = F.when(some, half_even(100 * F.col("weighted"), F.col("weights"))).otherwise(0)
    doc = F.when(some, half_even(F.col("docs"), F.col("n_production"))).otherwise(0)
    cc = F.when(some, half_even(F.col("ccs"), F.col("n_production"))).otherwise(0)
    out = sums.select("n_files", "n_production", (F.col("n_files") - F.col("n_production")).alias("n_other"), "files_with_issues",
                      "security_issues", "lines_of_code",
                      (score / 100).alias("avg_score"), (doc / 10).alias("avg_doc"), (cc / 10).alias("avg_cc"))
    issues = F.col("security_issues")
    safe = F.when(issues == 0, 100).otherwise(F.greatest(F.lit(0), F.bround(100 - F.pow(issues.cast("double"), 0.7) * 10, 0)))
    simple = F.greatest(F.lit(0), F.bround(100 - F.least(F.col("avg_cc") * 3, F.lit(80.0)), 0))
    out = out.withColumn("security_score", safe.cast("long")).withColumn("simplicity_score", simple.cast("long"))
    health = 0.35 * F.col("avg_score") + 0.25 * F.col("security_score") + 0.20 * F.col("avg_doc") + 0.20 * F.col("simplicity_score")
    return out.withColumn("health_score", F.bround(health, 0).cast("long"))
