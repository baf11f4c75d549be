"""Dependencies with the versions that are installed, newer releases and known vulnerabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Versions that say nothing, and what one version of a node package and nothing else looks like.
UNKNOWN = ("unknown", "latest", "*", "")
NODE_EXACT = r"^\s*=?\s*v?(\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.\-+]+)?)\s*$"
NODE = ("node", "node-dev")


def project_name(name: Column) -> Column:
    """Name as registries compare it."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def older(version: Column, than: Column) -> Column:
    """Whether a version of dotted numbers is older; of other versions, whether they differ. False where one says nothing."""
    plain = r"^\d+(\.\d+)*$"
    # trailing zeros don't count, 1.0 being 1
    parts = lambda v: F.transform(F.split(F.regexp_replace(v, r"(\.0+)+$", ""), r"\."), lambda p: p.cast("long"))
    got = F.when(version.rlike(plain) & than.rlike(plain), parts(version) < parts(than)).otherwise(F.trim(version) != F.trim(than))
    return F.coalesce(F.when(version.isin(*UNKNOWN) | (than == ""), False).otherwise(got), F.lit(False))


def first_of(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One ``value`` for each key, that of the first row by ``seq``."""
    return rows.groupBy(*keys).agg(F.min_by(value, "seq").alias(value))


def enriched(deps: DataFrame, locked: DataFrame, latest: DataFrame, flaws: DataFrame) -> DataFrame:
    """``deps`` (dep_id, name, type, version, spec) with version, version_source, latest_version, is_outdated, vuln_lookup, n_flaws, risk_level.

    ``locked``: ecosystem (python or node), name, version, seq; ``latest``: name, version; ``flaws``: ecosystem, name, version, severity.
    A python version that isn't known is taken from the lockfile; a node version from the lockfile, else from an exact spec, else
    nothing is asked about it. Only a known version is looked up (vuln_lookup ok, else skipped). Null names match nothing.
    """
    python, node = F.col("type") == "python", F.col("type").isin(*NODE)
    ecosystem = F.when(python, "python").when(node, "node")
    rows = deps.withColumn("ecosystem", ecosystem).withColumn("key", F.when(python, project_name(F.col("name"))).otherwise(F.col("name")))
    keyed = lambda t: t.withColumn("key", F.when(F.col("ecosystem") == "python", project_name(F.col("name"))).otherwise(F.col("name")))
    locks = first_of(keyed(locked), ["ecosystem", "key"], "version").withColumnRenamed("version", "_locked")
    newest = latest.withColumn("key", project_name(F.col("name"))).groupBy("key").agg(F.max_by("version", F.length("version")).alias("_latest"))
    rows = rows.join(locks, ["ecosystem", "key"], "left").join(newest, "key", "left")
    pinned = F.nullif(F.regexp_extract(F.coalesce("spec", F.lit("")), NODE_EXACT, 1), F.lit(""))
    fill = python & (F.col("version") == "unknown") & F.col("_locked").isNotNull()
    version = F.when(fill, F.col("_locked")).when(node, F.coalesce("_locked", pinned, "version")).otherwise(F.col("version"))
    known = F.when(python, ~version.isin(*UNKNOWN)).when(node, F.coalesce("_locked", pinned).isNotNull()).otherwise(False)
    rows = rows.withColumns({
        "_known": F.coalesce(known, F.lit(False)), "version_source": F.when(fill, "lockfile"), "latest_version": F.when(python, F.col("_latest")),
        "version": version})
    rows = rows.withColumn("is_outdated", python & F.col("_known") & older(F.col("version"), F.col("latest_version")))
    found = keyed(flaws).groupBy("ecosystem", "key", "version").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.lower("severity") == "critical").alias("_critical"))
    rows = rows.join(found, ["ecosystem", "key", "version"], "left")
    n = F.when(F.col("_known"), F.coalesce("_n", F.lit(0))).otherwise(0)
    risk = F.when((n > 0) & F.col("_critical"), "Critical").when(n > 0, "High").when(F.col("is_outdated"), "Medium").otherwise("Low")
    return rows.select("dep_id", "name", "type", "version", "version_source", "latest_version", "is_outdated",
                       F.when(F.col("_known"), "ok").otherwise("skipped").alias("vuln_lookup"), n.cast("long").alias("n_flaws"), risk.alias("risk_level"))


def tiles(rows: DataFrame) -> DataFrame:
    """One row: number of dependencies, outdated, vulnerable and current ones, and the share of those not outdated in percent."""
    got = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_outdated").alias("outdated"), F.count_if(F.col("n_flaws") > 0).alias("vulnerable"))
    return got.select("*", (F.col("total") - F.col("outdated")).alias("current"), F.when(F.col("total") == 0, 100).otherwise(
        F.floor(100 * (F.col("total") - F.col("outdated")) / F.col("total") + 0.5)).cast("long").alias("up_to_date"))
