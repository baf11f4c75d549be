"""Graph queries. A call leads from the part of a line to the part of the order's next line.

Lines of a small quantity are the calls, which leaves a graph with cycles, tails and parts of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..plans import graphs
from ..session import read_table
from .base import Registry

R = Registry()

FEW = 3         # the greatest quantity of a line that is a call

SQL_EDGES = f"""
e AS (SELECT DISTINCT u, v FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_partkey AS u,
      lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS v FROM lineitem) WHERE l_quantity <= {FEW} AND v IS NOT NULL)"""


def calls(spark, sf_dir) -> DataFrame:
    """(u, v): distinct calls between parts. An order's lines are few, so the window has small partitions."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    edges = lines.select("l_quantity", F.col("l_partkey").alias("u"), F.lead("l_partkey").over(w).alias("v"))
    return edges.filter(F.col("v").isNotNull() & (F.col("l_quantity") <= FEW)).select("u", "v").distinct()


@R.query("call_cycles", f"""
WITH RECURSIVE {SQL_EDGES}, r AS (SELECT u AS a, v AS b FROM e UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b)
SELECT x.a AS node, max(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
def call_cycles(spark, sf_dir):
    """Parts that call themselves by some way round, with the greatest part of their cycle group."""
    return graphs.cycles(calls(spark, sf_dir))


@R.query("cycle_sizes", f"""
WITH RECURSIVE {SQL_EDGES}, r AS (SELECT u AS a, v AS b FROM e UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b),
c AS (SELECT x.a AS node, max(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT component, count(*) AS n_nodes, min(node) AS first_node FROM c GROUP BY component""")
def cycle_sizes(spark, sf_dir):
    return graphs.cycles(calls(spark, sf_dir)).groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"), F.min("node").alias("first_node"))


def taint(spark, sf_dir) -> DataFrame:
    """Untrusted parts have size 1, those of the operator size 2."""
    seeds = read_table(spark, sf_dir, "part").filter("p_size <= 2").select(
        F.col("p_partkey").alias("node"), F.when(F.col("p_size") == 1, 3).otherwise(2).alias("tier"))
    return graphs.reached(seeds, calls(spark, sf_dir))


SQL_TAINT = f"""
WITH RECURSIVE {SQL_EDGES},
seeds AS (SELECT p_partkey AS node, CASE WHEN p_size = 1 THEN 3 ELSE 2 END AS tier FROM part WHERE p_size <= 2),
r AS (SELECT node AS origin, node, tier FROM seeds UNION SELECT r.origin, e.v, r.tier FROM r JOIN e ON e.u = r.node),
worst AS (SELECT node, max(tier) AS tier FROM r GROUP BY node),
h(node, hops) USING KEY (node) AS (SELECT node, 0 FROM seeds UNION
  SELECT e.v, min(h.hops) + 1 FROM h JOIN e ON e.u = h.node WHERE e.v NOT IN (SELECT node FROM recurring.h) GROUP BY e.v)"""


@R.query("taint_reach", f"{SQL_TAINT} SELECT node, CAST(hops AS INTEGER) AS hops, CAST(tier AS INTEGER) AS tier FROM h JOIN worst USING (node)")
def taint_reach(spark, sf_dir):
    """Parts that untrusted ones reach, with the fewest calls between and the worst tier."""
    return taint(spark, sf_dir)


@R.query("taint_findings", f"""{SQL_TAINT}
SELECT node, p_brand AS sink, CAST(hops AS INTEGER) AS hops, CAST(tier AS INTEGER) AS tier, CAST(0.85 AS DOUBLE) AS confidence
FROM h JOIN worst USING (node) JOIN part ON p_partkey = node WHERE p_type = 'PROMO'""")
def taint_findings(spark, sf_dir):
    """Sinks, the parts of one type, among the reached ones."""
    sinks = read_table(spark, sf_dir, "part").filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("sink"))
    return taint(spark, sf_dir).join(sinks, "node").select("node", "sink", "hops", "tier", F.lit(0.85).alias("confidence"))


@R.query("unused_parts", f"""
WITH {SQL_EDGES} SELECT p_partkey AS node, p_name AS name FROM part
WHERE p_partkey NOT IN (SELECT v FROM e) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1)""")
def unused_parts(spark, sf_dir):
    """Parts that nothing calls and that begin no order."""
    nodes = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"))
    entry = read_table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_partkey").alias("node")).distinct()
    return graphs.unused(nodes, calls(spark, sf_dir), entry)


@R.query("connected_parts", f"""
WITH RECURSIVE {SQL_EDGES}, b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT u AS a, v AS b FROM b UNION SELECT r.a, b.v FROM r JOIN b ON b.u = r.b)
SELECT a AS node, least(a, min(b)) AS component FROM r GROUP BY a""")
def connected_parts(spark, sf_dir):
    """Parts that calls connect in either direction."""
    return graphs.connected(calls(spark, sf_dir))
