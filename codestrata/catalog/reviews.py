"""Queries over files, findings and votes: scores, risk, summary, top lists, ratios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import cohesion, scores
from ..session import read_table
from .base import Registry

R = Registry()


def _even(s: str, n: str) -> str:
    return (f"(({s}) // ({n}) + CASE WHEN 2 * (({s}) % ({n})) > ({n}) OR (2 * (({s}) % ({n})) = ({n}) "
            f"AND (({s}) // ({n})) % 2 = 1) THEN 1 ELSE 0 END)")


FACTS = f"""
items AS (SELECT l_orderkey AS file, CAST(floor(l_quantity) AS BIGINT) AS quantity, l_returnflag AS flag,
          CAST(floor(l_extendedprice) AS BIGINT) % 4 AS depth, CAST(round(l_discount * 100) AS BIGINT) AS cents,
          CAST(round(l_tax * 100) AS BIGINT) AS tax FROM lineitem),
per AS (SELECT file, count(*) AS n_functions, CAST(sum(quantity % 25 + 1) AS BIGINT) AS cc_sum, max(quantity % 25 + 1) AS max_cc,
        max(depth) AS max_depth, bool_or(flag = 'R') AS recursive, CAST(sum(4 * quantity) AS BIGINT) AS n_lines,
        count(*) FILTER (flag <> 'N') AS documented, count(*) FILTER (cents = 10) AS critical,
        count(*) FILTER (cents = 9) AS high, count(*) FILTER (cents = 8) AS medium, count(*) FILTER (cents = 7) AS low,
        count(*) FILTER (cents = 6) AS info, count(*) FILTER (cents = 5) AS other, count(*) FILTER (tax = 8) AS n_structural FROM items GROUP BY file),
facts AS (SELECT o_orderkey AS file, coalesce(n_functions, 0) AS n_functions, coalesce(max_cc, 1) AS max_cc, coalesce(max_depth, 0) AS max_depth,
          coalesce(recursive, false) AS recursive, coalesce(n_lines, 0) AS n_lines, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high,
          coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(info, 0) AS info, coalesce(other, 0) AS other, coalesce(n_structural, 0) AS n_structural,
          CASE WHEN n_functions > 0 THEN {_even('10 * cc_sum', 'n_functions')} ELSE 10 END AS cc_tenths,
          CASE WHEN n_functions > 0 THEN {_even('1000 * documented', 'n_functions')} ELSE 0 END AS doc_tenths,
          CASE o_orderpriority[1] WHEN '1' THEN 'orchestrator' WHEN '2' THEN 'cli_parser' WHEN '4' THEN 'data_model'
               WHEN '5' THEN 'test' ELSE 'utility' END AS role,
          CASE o_orderpriority[1] WHEN '3' THEN 'example' WHEN '4' THEN 'docs' WHEN '5' THEN 'test' ELSE 'production' END AS file_type
          FROM orders LEFT JOIN per ON o_orderkey = file),
prob AS (SELECT *, CAST(least(100, CASE WHEN max_cc > 10 THEN 30 WHEN max_cc > 5 THEN 10 ELSE 0 END
         + CASE WHEN max_depth >= 3 THEN 30 WHEN max_depth = 2 THEN 15 ELSE 0 END + least(critical * 20, 40)
         + CASE WHEN n_lines > 500 THEN 10 ELSE 0 END) AS BIGINT) AS p, critical + high + medium + low + info + other AS n_security FROM facts),
part_costs AS (SELECT *, n_security + n_structural AS n_issues, file_type = 'test' AS t,
         CASE WHEN file_type = 'test' THEN p * 15 // 100 ELSE p * 20 // 100 END AS guess,
         CASE WHEN file_type = 'test' THEN 5 * (critical + high) ELSE 12 * critical + 8 * high + 4 * medium + low + 3 * other END AS cost,
         CASE WHEN file_type = 'test' THEN 0 ELSE least(35, CASE WHEN max_cc > 3 THEN CAST(floor(pow(max_cc - 3, 1.3)) AS BIGINT) ELSE 0 END
         + CASE WHEN max_depth = 2 THEN 5 WHEN max_depth >= 3 THEN 15 ELSE 0 END) END AS drop_ FROM prob),
rest AS (SELECT *, CASE WHEN NOT t AND n_security = 0 AND max_cc <= 5 AND max_depth <= 1 AND p < 60 AND 100 - guess - drop_ - cost < 95
         THEN least(guess + drop_ + cost - 5, 15) ELSE 0 END AS bonus FROM part_costs),
files AS (SELECT *, CAST(greatest(CASE WHEN t THEN 75 ELSE 0 END, least(100, 100 - guess - drop_ - cost + bonus)) AS BIGINT) AS score FROM rest)"""


def _files(spark, sf_dir):
    return scores.scored(scores.file_facts(spark, sf_dir))


@R.query("file_complexity", f"""WITH {FACTS} SELECT file, n_functions, cc_tenths / 10.0 AS avg_cc, max_cc, max_depth, recursive, n_lines FROM facts""")
def file_complexity(spark, sf_dir):
    """Complexity of each file from its functions."""
    return scores.file_facts(spark, sf_dir).select(
        "file", "n_functions", (F.col("cc_tenths") / 10).alias("avg_cc"), "max_cc", "max_depth", "recursive", "n_lines")


@R.query("risk_levels", f"""WITH {FACTS}, t AS (SELECT * FROM (VALUES ('orchestrator', 25, 40), ('cli_parser', 18, 30), ('utility', 10, 20),
('data_model', 12, 22), ('test', 5, 10)) v(role, warn, err))
SELECT file, role, CASE WHEN max_cc >= err THEN 'error' WHEN max_cc >= warn THEN 'warning' ELSE 'ok' END AS risk_level,
max_cc >= err OR max_depth >= 3 OR recursive AS hotspot FROM facts JOIN t USING (role)""")
def risk_levels(spark, sf_dir):
    """Risk level and hotspot mark of each file."""
    return scores.risk(scores.file_facts(spark, sf_dir)).select("file", "role", "risk_level", "hotspot")


@R.query("issue_probability", f"WITH {FACTS} SELECT file, p / 100.0 AS probability FROM prob")
def issue_probability(spark, sf_dir):
    return scores.probability(scores.file_facts(spark, sf_dir)).select("file", (F.col("p") / 100).alias("probability"))


@R.query("quality_scores", f"""WITH {FACTS} SELECT file, file_type, n_issues, n_security, score, CAST(bonus // 2 - guess AS BIGINT) AS heuristics,
CAST(-cost AS BIGINT) AS security, CAST(bonus // 2 - drop_ AS BIGINT) AS complexity, CASE WHEN score >= 90 THEN 'Excellent'
WHEN score >= 80 THEN 'Healthy' WHEN score >= 60 THEN 'Fair' WHEN score >= 40 THEN 'Needs attention' ELSE 'At risk' END AS verdict FROM files""")
def quality_scores(spark, sf_dir):
    """Score of each file with the points that its parts cost or bring."""
    return _files(spark, sf_dir).select("file", "file_type", "n_issues", "n_security", "score", "heuristics", "security", "complexity", scores.verdict(F.col("score")).alias("verdict"))


# cohesion by the rule itself: every pair of functions of a file
COHESION = """
fn AS (SELECT l_orderkey AS module, concat_ws('.', l_linenumber, l_partkey) AS f,
       [concat('s', l_suppkey), concat('f', l_returnflag, l_linestatus), concat('q', CAST(floor(l_quantity) AS BIGINT))] AS ids FROM lineitem),
fu AS (SELECT module, f, flatten(list(ids)) AS ids FROM fn GROUP BY module, f),
con AS (SELECT a.module, count(*) AS pairs, count(*) FILTER (list_has_any(a.ids, b.ids)) AS connected FROM fu a JOIN fu b ON a.module = b.module AND a.f < b.f GROUP BY 1),
coh AS (SELECT module, CAST(count(*) AS BIGINT) AS n_functions, CAST(coalesce(max(pairs), 0) AS BIGINT) AS pairs, CAST(coalesce(max(connected), 0) AS BIGINT) AS connected
        FROM fu LEFT JOIN con USING (module) GROUP BY module),
cohesion AS (SELECT *, CASE WHEN pairs = 0 THEN 1.0 ELSE connected / pairs END AS cohesion FROM coh)"""
WARNINGS = f"""{COHESION},
warn AS (SELECT file, 'long_file' AS type, 'medium' AS severity, CAST(n_lines AS BIGINT) AS n FROM files JOIN cohesion ON module = file
         WHERE file_type = 'production' AND n_lines > 500 AND cohesion < 0.40
         UNION ALL SELECT file, 'complex_function', CASE WHEN max_cc <= 20 THEN 'medium' ELSE 'high' END, max_cc FROM files
         WHERE file_type = 'production' AND max_cc > 10)"""


def _cohesion(spark, sf_dir):
    return cohesion.modules(scores.functions(spark, sf_dir))


@R.query("module_cohesion", f"WITH {COHESION} SELECT module, n_functions, pairs, connected, cohesion FROM cohesion")
def module_cohesion(spark, sf_dir):
    """Share of the pairs of a file's functions that touch something in common."""
    return _cohesion(spark, sf_dir)


@R.query("maintainability_warnings", f"WITH {FACTS}, {WARNINGS} SELECT file, type, severity, n FROM warn")
def maintainability_warnings(spark, sf_dir):
    """Long production files of low cohesion, and those with a complex function."""
    return scores.warnings(_files(spark, sf_dir), _cohesion(spark, sf_dir))


@R.query("repository_summary", f"""WITH {FACTS}, {WARNINGS},
s AS (SELECT count(*) AS n_files, count(*) FILTER (file_type = 'production') AS n_production, count(*) FILTER (n_structural > 0) AS files_with_issues,
 CAST(coalesce(sum(n_security) FILTER (file_type = 'production'), 0) AS BIGINT) AS security_issues, CAST(coalesce(sum(n_lines), 0) AS BIGINT) AS lines_of_code,
 sum(score * CASE file_type WHEN 'production' THEN 100 WHEN 'example' THEN 10 WHEN 'docs' THEN 5 ELSE 0 END) AS weighted,
 sum(CASE file_type WHEN 'production' THEN 100 WHEN 'example' THEN 10 WHEN 'docs' THEN 5 ELSE 0 END) AS weights,
 sum(doc_tenths) FILTER (file_type = 'production') AS docs, sum(cc_tenths) FILTER (file_type = 'production') AS ccs FROM files),
a AS (SELECT n_files, n_production, n_files - n_production AS n_other, files_with_issues, security_issues, lines_of_code,
 coalesce({_even('100 * weighted', 'weights')}, 0) / 100.0 AS avg_score,
 coalesce({_even('docs', 'n_production')}, 0) / 10.0 AS avg_doc, coalesce({_even('ccs', 'n_production')}, 0) / 10.0 AS avg_cc FROM s),
b AS (SELECT *, CAST(CASE WHEN security_issues = 0 THEN 100 ELSE greatest(0, round_even(100 - pow(security_issues, 0.7) * 10, 0)) END AS BIGINT) AS security_score,
 CAST(greatest(0, round_even(100 - least(avg_cc * 3, 80), 0)) AS BIGINT) AS simplicity_score FROM a)
SELECT *, CAST(round_even(0.35 * avg_score + 0.25 * security_score + 0.20 * avg_doc + 0.20 * simplicity_score, 0) AS BIGINT) AS health_score,
 (SELECT count(*) FROM warn) AS n_warnings FROM b""")
def repository_summary(spark, sf_dir):
    """The one-row summary with the health score and the number of warnings."""
    files = _files(spark, sf_dir)
    n = scores.warnings(files, _cohesion(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_warnings"))
    return scores.summary(files).crossJoin(F.broadcast(n))         # one row each


def _top(name, order, keep="true", n=5):
    """Register a top list: the limit is the feature, ties go to the smaller file."""
    @R.query(name, f"WITH {FACTS} SELECT file, score, cc_tenths / 10.0 AS avg_cc, n_issues, n_security FROM files WHERE {keep} ORDER BY {order}, file LIMIT {n}")
    def query(spark, sf_dir):
        return _files(spark, sf_dir).filter(keep).orderBy(
            F.expr(order.removesuffix(" DESC")).desc() if order.endswith(" DESC") else F.expr(order), "file").limit(n).select(
            "file", "score", (F.col("cc_tenths") / 10).alias("avg_cc"), "n_issues", "n_security")
    return query


_top("top_complex_files", "cc_tenths DESC", "file_type = 'production' AND cc_tenths > 30")
_top("top_risk_files", "n_issues + 2 * n_security DESC", "file_type = 'production' AND n_issues > 0", 3)
_top("worst_scored_files", "score", n=15)
_top("top_scored_files", "score DESC", "cc_tenths > 0 OR n_issues > 0 OR score < 100", 15)


@R.query("headline_findings", """
SELECT l_orderkey AS file, l_linenumber AS line, CAST(round(l_discount * 100) AS BIGINT) AS severity FROM lineitem
WHERE round(l_discount * 100) >= 8 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY round(l_discount * 100) DESC, l_linenumber) = 1""")
def headline_findings(spark, sf_dir):
    """The worst finding of each file, the first of equal ones; max_by combines before the shuffle."""
    found = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.round(F.col("l_discount") * 100).cast("long").alias("severity"))
    best = F.max(F.struct("severity", (-F.col("line")).alias("back"), "line"))
    return found.filter("severity >= 8").groupBy("file").agg(best.alias("b")).select("file", "b.line", "b.severity")


@R.query("link_degrees", """
WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)
SELECT 'supplier' AS kind, s AS node, count(*) AS degree FROM e GROUP BY s
UNION ALL SELECT 'part', p, count(*) FROM e GROUP BY p""")
def link_degrees(spark, sf_dir):
    """Out-degree of suppliers and in-degree of parts over distinct links."""
    e = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    ends = e.select(F.explode(F.array(F.struct(F.lit("supplier").alias("kind"), F.col("s").alias("node")),
                                      F.struct(F.lit("part").alias("kind"), F.col("p").alias("node")))).alias("x"))
    return ends.select("x.*").groupBy("kind", "node").agg(F.count(F.lit(1)).alias("degree"))


@R.query("most_linked", """
WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
d AS (SELECT 'supplier' AS kind, s AS node, count(*) AS degree FROM e GROUP BY s UNION ALL SELECT 'part', p, count(*) FROM e GROUP BY p)
SELECT kind, node, degree FROM d QUALIFY row_number() OVER (PARTITION BY kind ORDER BY degree DESC, node) = 1""")
def most_linked(spark, sf_dir):
    """The node of each kind with most links, the smaller of equal ones."""
    best = F.max(F.struct("degree", (-F.col("node")).alias("back"), "node"))
    return link_degrees(spark, sf_dir).groupBy("kind").agg(best.alias("b")).select("kind", "b.node", "b.degree")


@R.query("top_nodes", """
WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
d AS (SELECT 'supplier' AS kind, s AS node, count(*) AS degree FROM e GROUP BY s UNION ALL SELECT 'part', p, count(*) FROM e GROUP BY p)
SELECT kind, node, degree FROM d ORDER BY degree DESC, kind, node LIMIT 36""")
def top_nodes(spark, sf_dir):
    """The 36 nodes with most links."""
    return link_degrees(spark, sf_dir).orderBy(F.desc("degree"), "kind", "node").limit(36)


@R.query("vote_precision", """
WITH v AS (SELECT count(*) FILTER (quality = 1) AS up, count(*) FILTER (quality = 0) AS down FROM labels)
SELECT up, down, up + down AS total, CASE WHEN up + down > 0 THEN round(up / (up + down), 4) END AS precision_estimate FROM v""")
def vote_precision(spark, sf_dir):
    """Share of votes that agree; null before the first vote."""
    v = read_table(spark, sf_dir, "labels").agg(F.count_if(F.col("quality") == 1).alias("up"), F.count_if(F.col("quality") == 0).alias("down"))
    total = F.col("up") + F.col("down")
    return v.select("up", "down", total.alias("total"), F.when(total > 0, F.round(F.col("up") / total, 4)).alias("precision_estimate"))


@R.query("detector_ratios", """
WITH f AS (SELECT doc_id, n_chars < 200 AS short, regexp_matches(lower(text), '\\b(idiot|stupid|moron|scum)') AS rude FROM documents),
x AS (SELECT 'short' AS type, quality = 0 AS truth, short AS found FROM labels JOIN f USING (doc_id)
      UNION ALL SELECT 'rude', toxic = 1, rude FROM labels JOIN f USING (doc_id)),
c AS (SELECT coalesce(type, 'all') AS type, count(*) FILTER (truth AND found) AS tp, count(*) FILTER (NOT truth AND found) AS fp,
      count(*) FILTER (truth AND NOT found) AS fn FROM x GROUP BY ROLLUP (type))
SELECT *, tp / nullif(tp + fp, 0) AS precision_ratio, tp / nullif(tp + fn, 0) AS recall_ratio FROM c""")
def detector_ratios(spark, sf_dir):
    """Precision and recall of two simple detectors against the labels, and over both; null where undefined."""
    found = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("n_chars") < 200).alias("short"), F.lower("text").rlike(r"\b(idiot|stupid|moron|scum)").alias("rude"))
    one = lambda kind, truth: F.struct(F.lit(kind).alias("type"), truth.alias("truth"), F.col(kind).alias("found"))
    x = read_table(spark, sf_dir, "labels").join(found, "doc_id").select(
        F.explode(F.array(one("short", F.col("quality") == 0), one("rude", F.col("toxic") == 1))).alias("x")).select("x.*")
    c = x.rollup("type").agg(
        F.count_if(F.expr("truth and found")).alias("tp"), F.count_if(F.expr("not truth and found")).alias("fp"),
        F.count_if(F.expr("truth and not found")).alias("fn"))
    return c.select(F.coalesce("type", F.lit("all")).alias("type"), "tp", "fp", "fn",
                    F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision_ratio"),
                    F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall_ratio"))


@R.query("first_seen_parts", r"""
SELECT regexp_replace(lower(p_name), '[-_.]+', '-', 'g') AS name, lower(p_type) AS kind, min(p_partkey) AS first_part, count(*) AS n
FROM part GROUP BY 1, 2""")
def first_seen_parts(spark, sf_dir):
    """Parts once per normalized name and type, the first one standing for all."""
    return read_table(spark, sf_dir, "part").groupBy(
        F.regexp_replace(F.lower("p_name"), "[-_.]+", "-").alias("name"), F.lower("p_type").alias("kind")).agg(
        F.min("p_partkey").alias("first_part"), F.count(F.lit(1)).alias("n"))
