"""Dependencies: a part stands for one, its order lines for lockfile entries, releases and vulnerabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import dependencies as dep
from ..session import read_table
from .base import Registry
from .reviews import link_degrees

R = Registry()

SQL_DEPS = r"""
d AS (SELECT p_partkey AS dep_id, p_name || '_' || p_partkey AS name, CASE WHEN p_type = 'PROMO' THEN 'other' WHEN p_type = 'SMALL' THEN 'node-dev' WHEN p_type IN ('LARGE', 'MEDIUM') THEN 'node' ELSE 'python' END AS type,
      CASE WHEN p_size > 30 THEN 'unknown' ELSE concat(p_size, '.', p_size % 7, '.0') END AS version,
      CASE WHEN p_size <= 15 THEN concat('=', p_size, '.', p_size % 7, '.0') ELSE concat('^', p_size, '.1.0') END AS spec FROM part),
l AS (SELECT l_partkey AS dep_id, CAST(floor(l_quantity) AS BIGINT) AS q, l_orderkey * 10 + l_linenumber AS seq, CAST(round(l_discount * 100) AS BIGINT) AS cents, l_returnflag AS flag FROM lineitem),
lock AS (SELECT dep_id, arg_min(concat(q, '.', q % 7, '.0'), seq) AS locked FROM l WHERE cents <= 1 GROUP BY dep_id),
rel AS (SELECT dep_id, concat(max(q), '.1') AS latest FROM l WHERE cents = 2 GROUP BY dep_id),
flaw AS (SELECT dep_id, concat(q, '.', q % 7, '.0') AS version, count(*) AS n, bool_or(flag = 'R') AS critical FROM l WHERE cents = 10 GROUP BY ALL),
v AS (SELECT d.*, locked, latest, type = 'python' AND d.version = 'unknown' AND locked IS NOT NULL AS fill,
      CASE WHEN type = 'python' AND d.version = 'unknown' AND locked IS NOT NULL THEN locked
           WHEN type LIKE 'node%' THEN coalesce(locked, CASE WHEN starts_with(spec, '=') THEN substr(spec, 2) END, d.version) ELSE d.version END AS now,
      CASE type WHEN 'python' THEN d.version <> 'unknown' OR locked IS NOT NULL WHEN 'other' THEN false ELSE locked IS NOT NULL OR starts_with(spec, '=') END AS known
      FROM d LEFT JOIN lock USING (dep_id) LEFT JOIN rel USING (dep_id)),
o AS (SELECT v.*, type = 'python' AND known AND coalesce(TRY_CAST(string_split(now, '.')[1] AS INTEGER) < CAST(string_split(latest, '.')[1] AS INTEGER)
      OR (TRY_CAST(string_split(now, '.')[1] AS INTEGER) = CAST(string_split(latest, '.')[1] AS INTEGER) AND TRY_CAST(string_split(now, '.')[2] AS INTEGER) < 1), false) AS is_outdated,
      CASE WHEN known THEN coalesce(n, 0) ELSE 0 END AS n_flaws, critical FROM v LEFT JOIN flaw ON flaw.dep_id = v.dep_id AND flaw.version = now AND type <> 'other'),
e AS (SELECT dep_id, name, type, now AS version, CASE WHEN fill THEN 'lockfile' END AS version_source, CASE WHEN type = 'python' THEN latest END AS latest_version,
      is_outdated, CASE WHEN known THEN 'ok' ELSE 'skipped' END AS vuln_lookup, n_flaws,
      CASE WHEN n_flaws > 0 AND critical THEN 'Critical' WHEN n_flaws > 0 THEN 'High' WHEN is_outdated THEN 'Medium' ELSE 'Low' END AS risk_level FROM o)"""


def _dependencies(spark, sf_dir):
    size, kind = F.col("p_size"), F.col("p_type")
    name = F.concat_ws("_", "p_name", F.col("p_partkey").cast("string"))
    type_ = F.when(kind == "PROMO", "other").when(kind == "SMALL", "node-dev").when(kind.isin("LARGE", "MEDIUM"), "node").otherwise("python")
    dotted = lambda n: F.concat_ws(".", n.cast("string"), (n % 7).cast("string"), F.lit("0"))
    parts = read_table(spark, sf_dir, "part")
    deps = parts.select(
        F.col("p_partkey").alias("dep_id"), name.alias("name"), type_.alias("type"), F.when(size > 30, "unknown").otherwise(dotted(size)).alias("version"),
        F.when(size <= 15, F.concat(F.lit("="), dotted(size))).otherwise(F.concat(F.lit("^"), size.cast("string"), F.lit(".1.0"))).alias("spec"))
    ecosystem = F.when(F.col("type") == "python", "python").otherwise("node")
    named = deps.select("dep_id", "name", ecosystem.alias("ecosystem"))
    lines = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("dep_id"), F.col("l_quantity").cast("long").alias("q"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.round(F.col("l_discount") * 100).cast("long").alias("cents"), F.when(F.col("l_returnflag") == "R", "CRITICAL").otherwise("low").alias("severity")).join(named, "dep_id")
    versions = lines.withColumn("version", dotted(F.col("q")))
    releases = lines.filter("cents = 2").groupBy("name").agg(F.concat(F.max("q").cast("string"), F.lit(".1")).alias("version"))
    return dep.enriched(deps, versions.filter("cents <= 1"), releases, versions.filter("cents = 10"))


@R.query("dependency_rows", f"WITH {SQL_DEPS} SELECT * FROM e")
def dependency_rows(spark, sf_dir):
    """Each dependency with the version that is installed, what is newer, and what is known against it."""
    return _dependencies(spark, sf_dir)


@R.query("dependency_tiles", f"""WITH {SQL_DEPS}, t AS (SELECT count(*) AS total, count(*) FILTER (is_outdated) AS outdated, count(*) FILTER (n_flaws > 0) AS vulnerable FROM e)
SELECT *, total - outdated AS current, CAST(floor(100 * (total - outdated) / total + 0.5) AS BIGINT) AS up_to_date FROM t""")
def dependency_tiles(spark, sf_dir):
    """The counts of the dependency page."""
    return dep.tiles(_dependencies(spark, sf_dir))


@R.query("unused_dependencies", r"""
SELECT p_partkey AS dep_id, p_name AS name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49) AND p_type <> 'PROMO'""")
def unused_dependencies(spark, sf_dir):
    """Imported parts that no line of a large quantity refers to, less those that are imported for their side effects."""
    used = read_table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return read_table(spark, sf_dir, "part").filter("p_type <> 'PROMO'").join(used, "p_partkey", "left_anti").select(F.col("p_partkey").alias("dep_id"), F.col("p_name").alias("name"))


@R.query("top_subgraph", """
WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), d AS (SELECT 'supplier' AS kind, s AS node, count(*) AS degree FROM e GROUP BY s
 UNION ALL SELECT 'part', p, count(*) FROM e GROUP BY p), t AS (SELECT kind, node FROM d ORDER BY degree DESC, kind, node LIMIT 120)
SELECT s, p FROM e WHERE s IN (SELECT node FROM t WHERE kind = 'supplier') AND p IN (SELECT node FROM t WHERE kind = 'part')""")
def top_subgraph(spark, sf_dir):
    """The links between the 120 nodes that have most."""
    kept = link_degrees(spark, sf_dir).orderBy(F.desc("degree"), "kind", "node").limit(120)
    links = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    side = lambda kind, c: F.broadcast(kept.filter(F.col("kind") == kind).select(F.col("node").alias(c)))
    return links.join(side("supplier", "s"), "s", "left_semi").join(side("part", "p"), "p", "left_semi")


@R.query("issue_explorer", """
SELECT event_id, user_id AS file, lower(event_type) AS message, CASE WHEN value >= 100 THEN 'high' WHEN value >= 20 THEN 'medium' ELSE 'low' END AS severity
FROM events WHERE (contains(lower(event_type), 'er') OR contains(lower(props), 'er')) AND value >= 20""")
def issue_explorer(spark, sf_dir):
    """Issues that a search finds in message or file, of the severities asked for; filters come before the shaping."""
    hit = F.contains(F.lower("event_type"), F.lit("er")) | F.contains(F.lower("props"), F.lit("er"))
    severity = F.when(F.col("value") >= 100, "high").when(F.col("value") >= 20, "medium").otherwise("low")
    return read_table(spark, sf_dir, "events").filter(hit & (F.col("value") >= 20)).select(
        "event_id", F.col("user_id").alias("file"), F.lower("event_type").alias("message"), severity.alias("severity"))
