"""Call resolution and incremental runs.

A customer stands for a definition: its nation is the module, its market segment the class (none where the account is
overdrawn), its last three digits the name. An order is a call from its customer's place, of its own last three digits; an
urgent one is code that runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..plans import calls, incremental, scores
from ..session import read_table, shared_folder
from .base import Registry
from .reviews import FACTS, _even

R = Registry()

SQL_CALLS = """
d AS (SELECT c_custkey AS def_id, c_nationkey AS module, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS class, c_custkey % 1000 AS name FROM customer),
c AS (SELECT o_orderkey AS call_id, d.module, d.class, o_orderkey % 1000 AS name,
      CASE o_orderstatus WHEN 'F' THEN 'name' WHEN 'O' THEN 'self' ELSE 'attr' END AS kind, o_orderpriority = '1-URGENT' AS urgent FROM orders JOIN d ON def_id = o_custkey),
r AS (SELECT c.*, (SELECT max(def_id) FROM d WHERE d.module = c.module AND d.name = c.name AND d.class IS NULL AND kind = 'name') AS in_module,
      (SELECT max(def_id) FROM d WHERE d.module = c.module AND d.class = c.class AND d.name = c.name AND kind = 'self') AS in_class,
      (SELECT count(*) FROM d WHERE d.name = c.name) AS n, (SELECT max(def_id) FROM d WHERE d.name = c.name) AS any_def,
      (SELECT max(def_id) FROM d WHERE d.name = c.name AND d.class IS NULL AND kind = 'name' HAVING count(DISTINCT module) = 1) AS only_def FROM c),
t AS (SELECT *, CASE WHEN in_module IS NOT NULL THEN 'module' WHEN in_class IS NOT NULL THEN 'class' WHEN n > 0 THEN 'name' ELSE 'none' END AS how FROM r)"""


def definitions(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("def_id"), F.col("c_nationkey").alias("module"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("class"), (F.col("c_custkey") % 1000).alias("name"))


def call_sites(spark, sf_dir) -> DataFrame:
    places = definitions(spark, sf_dir).select(F.col("def_id").alias("o_custkey"), "module", "class")
    kind = F.when(F.col("o_orderstatus") == "F", "name").when(F.col("o_orderstatus") == "O", "self").otherwise("attr")
    return read_table(spark, sf_dir, "orders").join(places, "o_custkey").select(
        F.col("o_orderkey").alias("call_id"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"), "module", "class", (F.col("o_orderkey") % 1000).alias("name"), kind.alias("kind"))


@R.query("call_targets", f"""WITH {SQL_CALLS} SELECT call_id, how, coalesce(in_module, in_class, CASE WHEN n = 1 THEN any_def END) AS target,
CASE WHEN how IN ('module', 'class') THEN 1 ELSE n END AS n_targets FROM t""")
def call_targets(spark, sf_dir):
    """The definition that each call means, or how many of its name it may mean."""
    return calls.resolve(call_sites(spark, sf_dir), definitions(spark, sf_dir))


@R.query("unique_call_targets", f"WITH {SQL_CALLS} SELECT call_id, coalesce(in_module, in_class, only_def) AS target FROM t")
def unique_call_targets(spark, sf_dir):
    """As call_targets, but a name is only followed to another module where one function has it."""
    return calls.resolve_unique(call_sites(spark, sf_dir), definitions(spark, sf_dir))


@R.query("unreferenced_definitions", f"""WITH {SQL_CALLS}
SELECT def_id, module, class, name FROM d WHERE class IS DISTINCT FROM 'BUILDING'
AND def_id NOT IN (SELECT coalesce(in_module, in_class) FROM t WHERE how IN ('module', 'class') AND urgent) AND name NOT IN (SELECT name FROM t WHERE how = 'name' AND urgent)""")
def unreferenced_definitions(spark, sf_dir):
    """Definitions that no code that runs calls; those of one class are entry points."""
    return calls.unreferenced(definitions(spark, sf_dir), call_sites(spark, sf_dir).filter("urgent"), F.col("class") == "BUILDING")


# the summary of a run over everything
SQL_SUMMARY = f"""WITH {FACTS},
s AS (SELECT count(*) AS n_files, count(*) FILTER (file_type = 'production') AS n_production, count(*) FILTER (n_structural > 0) AS files_with_issues,
 CAST(coalesce(sum(n_security) FILTER (file_type = 'production'), 0) AS BIGINT) AS security_issues, CAST(coalesce(sum(n_lines), 0) AS BIGINT) AS lines_of_code,
 sum(score * CASE file_type WHEN 'production' THEN 100 WHEN 'example' THEN 10 WHEN 'docs' THEN 5 ELSE 0 END) AS weighted,
 sum(CASE file_type WHEN 'production' THEN 100 WHEN 'example' THEN 10 WHEN 'docs' THEN 5 ELSE 0 END) AS weights FROM files)
SELECT n_files, n_production, files_with_issues, security_issues, lines_of_code, coalesce({_even('100 * weighted', 'weights')}, 0) / 100.0 AS avg_score FROM s"""


@R.query("incremental_summary", SQL_SUMMARY)
def incremental_summary(spark, sf_dir):
    """The summary after a refresh: an earlier run knew the older half of the files, some of them in another state."""
    dates = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), "o_orderdate", "o_orderpriority")
    middle = dates.agg(F.percentile_approx("o_orderdate", 0.5)).first()[0]
    changed = dates.filter((F.col("o_orderdate") > F.lit(middle)) | (F.col("o_orderpriority") == "1-URGENT"))
    earlier = scores.file_facts(spark, sf_dir, dates.filter(F.col("o_orderdate") <= F.lit(middle)))
    earlier = earlier.withColumn("critical", F.when(F.col("role") == "orchestrator", F.col("critical") + 3).otherwise(F.col("critical")))
    gone = spark.range(1).select((-F.col("id") - 1).alias("file"))          # a file of the earlier run that is no more
    path = "/".join([shared_folder(spark), "codestrata", spark.sparkContext.applicationId, f"store-{uuid.uuid4().hex[:12]}"])
    incremental.create(earlier.unionByName(earlier.limit(1).withColumn("file", F.lit(-1).cast("long"))), path)
    incremental.refresh(path, changed.select("file").unionByName(gone), scores.file_facts(spark, sf_dir, changed))
    return scores.summary(scores.scored(incremental.read(spark, path))).select(
        "n_files", "n_production", "files_with_issues", "security_issues", "lines_of_code", "avg_score")
