"""Large classes, frameworks, layers and the history of scans.

A part stands for a class, the orders that have it for its methods and their quantities for attributes; a page's
reversed host is what it imports.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import architecture as arch
from ..session import read_table
from .base import Registry

R = Registry()

SQL_GROUPS = """
WITH RECURSIVE m AS (SELECT DISTINCT l_partkey AS class, l_orderkey AS method, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS attr FROM lineitem),
e AS (SELECT DISTINCT a.class, a.method AS u, b.method AS v FROM m a JOIN m b ON a.class = b.class AND a.attr = b.attr),
r AS (SELECT class, u, v FROM e UNION SELECT r.class, r.u, e.v FROM r JOIN e ON e.class = r.class AND e.u = r.v),
least_of AS (SELECT class, u, min(v) AS part FROM r GROUP BY class, u),
g AS (SELECT x.class, count(*) AS n_methods, count(DISTINCT coalesce(part, -x.method - 1)) AS groups
      FROM (SELECT DISTINCT class, method FROM m) x LEFT JOIN least_of l ON l.class = x.class AND l.u = x.method GROUP BY x.class)"""


def _touched(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("class"), F.col("l_orderkey").alias("method"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("attribute"))


@R.query("method_groups", f"{SQL_GROUPS} SELECT class, n_methods, groups FROM g")
def method_groups(spark, sf_dir):
    """Number of unrelated groups of methods in each class."""
    return arch.method_groups(_touched(spark, sf_dir))


@R.query("god_objects", f"""{SQL_GROUPS} SELECT class, n_methods, groups, CASE WHEN n_methods >= 25 THEN 'very large' ELSE 'unrelated groups' END AS reason
FROM g WHERE n_methods >= 25 OR (n_methods >= 12 AND groups >= 3)""")
def god_objects(spark, sf_dir):
    """Classes that are very large, or large and of unrelated groups, largest first."""
    return arch.god_objects(arch.method_groups(_touched(spark, sf_dir))).orderBy(F.desc("n_methods"), "class")


# what pages import: reversed hosts; prefixes stand for frameworks
SIGNATURES = {"web": {"com-sites": ("com.example",), "net-sites": ("net.example",)}, "test": {"spam": ("org.example.spam-farm",), "blog": ("com.example.thren", "org.example")}}
_SIG = ", ".join(f"('{c}', '{f}', '{p}')" for c, fs in SIGNATURES.items() for f, ps in fs.items() for p in ps)
SQL_HITS = rf"""
WITH i AS (SELECT page_id, array_to_string(list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.')), '.') AS name FROM pages),
s AS (SELECT * FROM (VALUES {_SIG}) v(category, framework, prefix)),
h AS (SELECT category, framework, count(DISTINCT page_id) AS n_files FROM i JOIN s ON name = prefix OR starts_with(name, prefix || '.') GROUP BY ALL)"""


def _hits(spark, sf_dir):
    host = F.array_join(F.reverse(F.split(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), r"\.")), ".")
    return arch.detected(read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), host.alias("name")), SIGNATURES)


@R.query("framework_hits", f"{SQL_HITS} SELECT category, framework, n_files, least(CAST(round(0.5 + 0.1 * n_files, 2) AS DOUBLE), 0.99) AS confidence FROM h")
def framework_hits(spark, sf_dir):
    """Files that import each framework, and how sure that makes its use."""
    return _hits(spark, sf_dir)


@R.query("primary_frameworks", f"{SQL_HITS} SELECT category, framework FROM h QUALIFY row_number() OVER (PARTITION BY category ORDER BY n_files DESC, framework) = 1")
def primary_frameworks(spark, sf_dir):
    return arch.primary(_hits(spark, sf_dir))


@R.query("scan_history", """
SELECT o_orderkey AS id, c_name AS repo, o_orderdate AS created_at, coalesce(n, 0) AS files_analyzed, coalesce(issues, 0) AS issues_found
FROM orders JOIN customer ON c_custkey = o_custkey
LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n, CAST(sum(CAST(floor(l_quantity) AS BIGINT) % 7) AS BIGINT) AS issues FROM lineitem GROUP BY 1) ON k = o_orderkey
WHERE o_orderstatus = 'F' ORDER BY created_at DESC NULLS LAST, id LIMIT 50""")
def scan_history(spark, sf_dir):
    """The fifty newest complete scans; only their files and repositories are looked up."""
    newest = read_table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderdate").alias("created_at")).orderBy(F.desc_nulls_last("created_at"), "id").limit(50)
    repos = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("repo"))
    files = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_quantity").cast("long") % 7).alias("found"))
    counts = files.join(F.broadcast(newest.select("id")), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("found").alias("issues"))
    return repos.join(F.broadcast(newest), "o_custkey").join(counts, "id", "left").select(
        "id", "repo", "created_at", F.coalesce("n", F.lit(0)).alias("files_analyzed"), F.coalesce("issues", F.lit(0)).alias("issues_found"))
