"""Nearest neighbours, prefixes of module names, trees of paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import neighbours, paths
from ..session import read_table
from .base import Registry

R = Registry()


@R.query("nearest_vectors", """
WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM b WHERE vec_id % 20 = 0),
q AS (SELECT vec_id AS query, list_transform(v, lambda x: x / CASE WHEN norm > 0 THEN norm ELSE 1 END) AS v FROM n),
d AS (SELECT query, vec_id AS id, list_sum(list_transform(list_zip(q.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM q, b)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, id) AS INTEGER) AS rank, id, round(distance, 6) AS distance
FROM d QUALIFY rank <= 3""")
def nearest_vectors(spark, sf_dir):
    """The three vectors nearest to each twentieth one, which is made a unit vector first."""
    base = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    got = neighbours.nearest(base, base.filter("id % 20 = 0"), 3)
    return got.withColumn("distance", F.round("distance", 6))


_SITE = r"""
u AS (SELECT page_id, list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.')) AS host,
      list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1), '/'), lambda x: x <> '') AS path FROM pages),
k AS (SELECT page_id, list_concat(host, path) AS parts, len(host) AS h FROM u)"""


def _parts():
    host = F.reverse(F.split(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), r"\."))
    path = F.filter(F.split(F.regexp_extract("url", "^[a-z]+://[^/?#]*/?([^?#]*)", 1), "/"), lambda p: p != "")
    return host, path


@R.query("site_modules", f"""
WITH {_SITE}, p AS (SELECT array_to_string(parts[1:n], '.') AS module, page_id FROM k, unnest(range(h, len(parts))) AS t(n)),
m AS (SELECT module FROM p GROUP BY module HAVING count(*) > 1),
x AS (SELECT DISTINCT array_to_string(parts, '.') AS name FROM k)
SELECT name, (SELECT arg_max(module, length(module)) FROM m WHERE name = module OR starts_with(name, module || '.')) AS module FROM x""")
def site_modules(spark, sf_dir):
    """Each page's dotted name with its longest prefix that is a module: a host or folder that more than one page is under."""
    host, path = _parts()
    pages = read_table(spark, sf_dir, "pages").select(host.alias("host"), path.alias("path")).select(
        F.array_join(F.concat("host", "path"), ".").alias("name"), "host", "path")
    above = pages.filter("size(path) > 0").select(F.explode(F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda n: F.array_join(
        F.concat("host", F.slice("path", 1, n)), "."))).alias("module"))
    known = above.groupBy("module").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return paths.longest_prefix(pages, known)


@R.query("page_tree", f"""
WITH {_SITE}, f AS (SELECT DISTINCT parts FROM k WHERE len(parts) > 0),
d AS (SELECT DISTINCT parts[1:n] AS parts FROM f, unnest(range(1, len(parts))) AS t(n)),
r AS (SELECT parts, 'file' AS kind FROM f UNION ALL SELECT parts, 'dir' FROM d),
s AS (SELECT parts, kind, list_transform(range(1, len(parts) + 1), lambda i: {{'file': CASE WHEN kind = 'file' AND i = len(parts) THEN 1 ELSE 0 END,
      'low': lower(parts[i]), 'name': parts[i]}}) AS key FROM r)
SELECT row_number() OVER (ORDER BY key) AS position, array_to_string(parts, '/') AS path, kind, CAST(len(parts) AS INTEGER) AS depth FROM s""")
def page_tree(spark, sf_dir):
    """The tree of all pages by reversed host and path, directories first at each level."""
    host, path = _parts()
    return paths.tree_order(read_table(spark, sf_dir, "pages").select(F.array_join(F.filter(F.concat(host, path), lambda p: p != ""), "/").alias("path")))
