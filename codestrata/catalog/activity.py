"""Queries over events, orders, pages and texts: states, limits, groups, matching and text rules."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as tx
from ..session import read_table
from .base import Registry

R = Registry()

_KEY = f"lower(regexp_replace(event_type, '^{tx.BLANK}+|{tx.BLANK}+$', '', 'g'))"


@R.query("grouped_issues", f"""
SELECT {_KEY} AS message, count(*) AS n, count(DISTINCT user_id) AS n_files, min(event_id) AS first_event
FROM events GROUP BY 1""")
def grouped_issues(spark, sf_dir):
    """Issues by message. Grouped by message and file first, so that a hot message is counted in parts."""
    return affected_files(spark, sf_dir).groupBy("message").agg(
        F.sum("n").alias("n"), F.count("file").alias("n_files"), F.min("first_event").alias("first_event"))


@R.query("affected_files", f"""
SELECT {_KEY} AS message, user_id AS file, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY 1, 2""")
def affected_files(spark, sf_dir):
    """Files under each message with the first issue in each: the list in long form, as its length has no bound."""
    return read_table(spark, sf_dir, "events").groupBy(
        tx.message_key(F.col("event_type")).alias("message"), F.col("user_id").alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@R.query("top_issues", f"""
SELECT {_KEY} AS message, max(value) AS confidence, count(*) AS n FROM events WHERE value >= 10 GROUP BY 1
ORDER BY confidence DESC, n DESC, message LIMIT 5""")
def top_issues(spark, sf_dir):
    """The five issues with the highest confidence, then count."""
    e = read_table(spark, sf_dir, "events").filter("value >= 10")
    return e.groupBy(tx.message_key(F.col("event_type")).alias("message")).agg(
        F.max("value").alias("confidence"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("confidence"), F.desc("n"), "message").limit(5)


@R.query("issue_categories", """
WITH t AS (SELECT lower(coalesce(event_type, '')) AS t FROM events)
SELECT CASE WHEN t = 'security' OR t LIKE '%credential%' OR t LIKE '%injection%' OR t LIKE '%vulnerability%' THEN 'security'
 WHEN t = 'performance' OR t LIKE '%loop%' OR t LIKE '%complex%' THEN 'performance'
 WHEN t = 'style' OR t LIKE '%format%' OR t LIKE '%naming%' OR t LIKE '%convention%' THEN 'style'
 WHEN t = 'logic' OR t LIKE '%error%' OR t LIKE '%bug%' OR t LIKE '%dead_code%' THEN 'logic' ELSE 'maintainability' END AS category,
 count(*) AS n FROM t GROUP BY 1""")
def issue_categories(spark, sf_dir):
    """Number of issues in each category that has any."""
    t = F.lower(F.coalesce("event_type", F.lit("")))
    # fixed values: what a type is or holds to fall in a category; the first match counts
    rules = [("security", ["credential", "injection", "vulnerability"]), ("performance", ["loop", "complex"]),
             ("style", ["format", "naming", "convention"]), ("logic", ["error", "bug", "dead_code"])]
    pairs = [(name, (t == name) | t.rlike("|".join(parts))) for name, parts in rules]
    category = F.coalesce(*[F.when(hit, name) for name, hit in pairs], F.lit("maintainability"))
    return read_table(spark, sf_dir, "events").groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@R.query("props_totals", """SELECT user_id, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS issues_found
FROM events GROUP BY user_id""")
def props_totals(spark, sf_dir):
    """Issues found per user, summed out of the stored JSON."""
    return read_table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("issues_found"))


@R.query("latest_states", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS progress,
max(ts) AS updated FROM events GROUP BY user_id""")
def latest_states(spark, sf_dir):
    """State of each scan after all its updates; a null field keeps the value before it."""
    at = F.struct("ts", "event_id")
    return read_table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max_by("event_type", at).alias("status"),
        F.max_by("value", F.when(F.col("value").isNotNull(), at)).alias("progress"), F.max("ts").alias("updated"))


@R.query("orphan_recovery", """
SELECT o_orderkey AS scan, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'error' END AS status,
CASE WHEN o_orderstatus IN ('F', 'O') THEN NULL ELSE 'interrupted' END AS stage FROM orders""")
def orphan_recovery(spark, sf_dir):
    """Scans that never ended become interrupted errors; running it twice changes nothing."""
    ended = F.col("o_orderstatus").isin("F", "O")
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("scan"), F.when(ended, F.col("o_orderstatus")).otherwise("error").alias("status"),
        F.when(~F.coalesce(ended, F.lit(False)), "interrupted").alias("stage"))


@R.query("trailing_counts", """
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS n
FROM events""")
def trailing_counts(spark, sf_dir):
    """Events of the user in the 60 seconds up to each one.

    Partitioned by user and minute, each event also sent to the next minute, so that a
    hot user is spread over as many tasks as it has minutes.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", us.alias("us"), F.floor(us / 60_000_000).alias("minute"))
    both = e.withColumn("slot", F.explode(F.array(F.col("minute"), F.col("minute") + 1)))
    w = Window.partitionBy("user_id", "slot").orderBy("us").rangeBetween(-59_999_999, 0)
    return both.withColumn("n", F.count(F.lit(1)).over(w)).filter("slot = minute").select("event_id", "user_id", "n")


@R.query("progress_changes", """
SELECT event_id, user_id, event_type FROM events
QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type""")
def progress_changes(spark, sf_dir):
    """Events whose type differs from the user's event before.

    Within a day by a window; a day's first event looks at the last type of the user's
    day before, found among one row per user and day.
    """
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.to_date("ts").alias("day"))
    days = e.groupBy("user_id", "day").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    days = days.withColumn("before", F.lag("last").over(Window.partitionBy("user_id").orderBy("day"))).drop("last")
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    inner = e.withColumn("rn", F.row_number().over(w)).withColumn("prev", F.lag("event_type").over(w))
    prev = F.when(F.col("rn") > 1, F.col("prev")).otherwise(F.col("before"))
    return inner.join(days, ["user_id", "day"]).filter(~prev.eqNullSafe(F.col("event_type"))).select("event_id", "user_id", "event_type")


@R.query("label_matches", """
WITH e AS (SELECT *, CAST(floor(epoch(ts) / 60) AS BIGINT) AS line FROM events)
SELECT event_id, user_id, line, EXISTS (SELECT 1 FROM e f WHERE f.event_type = 'click' AND f.user_id = e.user_id AND abs(f.line - e.line) <= 2) AS hit
FROM e WHERE event_type = 'error'""")
def label_matches(spark, sf_dir):
    """Labels with a finding of the same file within two lines.

    A finding is laid on each of the five lines that it can meet, which makes the match
    an equality on file and line.
    """
    e = read_table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60).alias("line"))
    reach = e.filter("event_type = 'click'").select("user_id", F.explode(F.sequence(F.col("line") - 2, F.col("line") + 2)).alias("line"))
    return e.filter("event_type = 'error'").join(
        reach.distinct().withColumn("found", F.lit(True)), ["user_id", "line"], "left").select(
        "event_id", "user_id", "line", F.coalesce("found", F.lit(False)).alias("hit"))


@R.query("incremental_plan", """
SELECT o_orderkey AS file, CASE WHEN p IS NULL THEN 'new' WHEN p <> o_totalprice THEN 'changed' ELSE 'reused' END AS action
FROM orders LEFT JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN -1 ELSE o_totalprice END AS p
 FROM orders WHERE o_orderstatus <> 'P') ON k = o_orderkey""")
def incremental_plan(spark, sf_dir):
    """Which files the per-file pass looks at anew: those that the earlier run has with other content or not at all."""
    now = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_totalprice").alias("content"))
    earlier = read_table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("file"), F.when(F.col("o_orderpriority") == "1-URGENT", -1.0).otherwise(F.col("o_totalprice")).alias("was"))
    action = F.when(F.col("was").isNull(), "new").when(F.col("was") != F.col("content"), "changed").otherwise("reused")
    return now.join(earlier, "file", "left").select("file", action.alias("action"))


@R.query("cached_results", """
WITH h AS (SELECT doc_id, md5(text) AS digest FROM documents)
SELECT doc_id, digest, digest IS NOT NULL AND digest IN (SELECT digest FROM h WHERE doc_id % 2 = 0 AND digest IS NOT NULL) AS hit FROM h""")
def cached_results(spark, sf_dir):
    """Documents whose content an earlier result, of any document with an even id, already covers."""
    h = read_table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    known = h.filter("doc_id % 2 = 0").select("digest").distinct().withColumn("known", F.lit(True))
    return h.join(known, "digest", "left").select("doc_id", "digest", F.coalesce("known", F.lit(False)).alias("hit"))


@R.query("language_lines", rf"""
WITH raw AS (SELECT lang, string_split_regex(text, '{tx.LINE_BREAK}') AS parts FROM documents WHERE text <> ''),
l AS (SELECT lang, CAST(sum(CASE WHEN parts[-1] = '' THEN len(parts) - 1 ELSE len(parts) END) AS BIGINT) AS n_lines FROM raw GROUP BY lang)
SELECT lang, n_lines, n_lines * 100.0 / sum(n_lines) OVER () AS share FROM l""")
def language_lines(spark, sf_dir):
    """Lines per language and their share in percent, over one row per language."""
    per = read_table(spark, sf_dir, "documents").filter("text <> ''").groupBy("lang").agg(
        F.sum(tx.line_count(F.col("text"))).cast("long").alias("n_lines"))
    total = per.agg(F.sum("n_lines").alias("total"))        # one row
    return per.crossJoin(F.broadcast(total)).select("lang", "n_lines", (F.col("n_lines") * 100 / F.col("total")).alias("share"))


# The longest address, and literal addresses that are private, local, reserved or sent to many.
_LONGEST = 512
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_NO_FETCH = (r"^(0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^192\.0\.[02]\.|"
             r"^198\.(1[89])\.|^198\.51\.100\.|^203\.0\.113\.")
_NO_FETCH_6 = r"^\[(::1?|::ffff:[^\]]*|f[cd][0-9a-f]{2}:[^\]]*|fe[89ab][0-9a-f]:[^\]]*|ff[0-9a-f]{2}:[^\]]*|2001:db8:[^\]]*)\]$"
# the hosts that may be fetched from; a parameter
HOSTS = ("spam-farm.example.org", "thin.example.com", "thther.example.org", "therin.example.net", "ththin.example.com", "m.therou.example.com")
_HOSTS = ", ".join(f"'{h}'" for h in HOSTS)


@R.query("url_checks", rf"""
WITH t AS (SELECT page_id, regexp_replace(coalesce(url, ''), '^{tx.BLANK}+|{tx.BLANK}+$', '', 'g') AS url FROM pages),
u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
 regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS place, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM t),
h AS (SELECT *, lower(regexp_extract(place, '(?:^|@)(\[[^\]]*\]|[^:@]*)(?::[0-9]*)?$', 1)) AS host FROM u)
SELECT page_id, CASE WHEN url = '' THEN 'empty' WHEN length(url) > {_LONGEST} THEN 'too long' WHEN scheme <> 'https' THEN 'not https'
 WHEN contains(place, '@') AND regexp_extract(place, '^(.*)@', 1) NOT IN ('', ':') THEN 'credentials' WHEN host = '' THEN 'no host'
 WHEN (regexp_matches(host, '{_QUAD}') AND regexp_matches(host, '{_NO_FETCH}')) OR regexp_matches(host, '{_NO_FETCH_6}') THEN 'private'
 WHEN host NOT IN ({_HOSTS}) THEN 'not allowed' WHEN replace(path, '/', '') = '' THEN 'no path' ELSE 'ok' END AS verdict FROM h""")
def url_checks(spark, sf_dir):
    """Whether each page's address is one that may be fetched, or the first rule that it breaks."""
    return read_table(spark, sf_dir, "pages").select("page_id", url_verdict(F.col("url"), HOSTS).alias("verdict"))


def url_verdict(url, hosts):
    """ok, or the first rule that an address breaks; only https on one of ``hosts``, without credentials and with a path."""
    url = tx.strip(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    place = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    host = F.lower(F.regexp_extract(place, r"(?:^|@)(\[[^\]]*\]|[^:@]*)(?::[0-9]*)?$", 1))
    private = (host.rlike(_QUAD) & host.rlike(_NO_FETCH)) | host.rlike(_NO_FETCH_6)
    named = F.contains(place, F.lit("@")) & ~F.regexp_extract(place, "^(.*)@", 1).isin("", ":")
    return (F.when(url == "", "empty").when(F.length(url) > _LONGEST, "too long").when(scheme != "https", "not https")
            .when(named, "credentials").when(host == "", "no host").when(private, "private").when(~host.isin(*hosts), "not allowed")
            .when(F.replace(path, F.lit("/"), F.lit("")) == "", "no path").otherwise("ok"))


@R.query("page_paths", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1) AS path FROM pages),
k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(path, '\', '/'), '\.py$', ''), '/+', '/', 'g'), '^/|/$', '', 'g') AS key FROM p)
SELECT page_id, path, regexp_extract(replace(path, '\', '/'), '([^/]*)$', 1) AS base, replace(regexp_replace(key, '(^|/)__init__$', ''), '/', '.') AS module FROM k""")
def page_paths(spark, sf_dir):
    """Path, base name and module key of each page's address."""
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*/?([^?#]*)", 1)
    return read_table(spark, sf_dir, "pages").select(
        "page_id", path.alias("path"), tx.base_name(tx.slashed(path)).alias("base"), tx.module_key(path).alias("module"))


# What a name that holds a credential has in it.
CREDENTIALS = ("password", "passwd", "secret", "api_key", "apikey", "token", "access_key", "private_key", "client_secret", "auth_token")
_NAMES = "|".join(CREDENTIALS)
# a name of at most a hundred letters, so that no long run of letters is read over and over
_SET = r"""([A-Za-z_][A-Za-z0-9_]{0,99})\s{0,20}[=:]\s{0,20}(?:"[^"]+"|'[^']+')"""
_SET_SQL = _SET.replace("'", "''")


@R.query("credential_lines", rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
n AS (SELECT doc_id, pos, unnest(regexp_extract_all(line, '{_SET_SQL}', 1)) AS name FROM l)
SELECT doc_id, CAST(pos AS INTEGER) AS line, name FROM n WHERE regexp_matches(lower(name), '{_NAMES}')""")
def credential_lines(spark, sf_dir):
    """Names that a line of a document sets to a quoted text and that speak of a credential."""
    return credentials(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def credentials(docs):
    """(doc_id, line, name). Only documents and lines that have a credential's word and a quote are looked at closely."""
    near = lambda c: F.lower(c).rlike(_NAMES) & c.rlike("[\"']")
    lines = docs.filter(near(F.col("text"))).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "row")).filter(near(F.col("row")))
    names = F.filter(F.regexp_extract_all("row", F.lit(_SET), 1), lambda n: F.lower(n).rlike(_NAMES))
    return lines.select("doc_id", (F.col("at") + 1).cast("int").alias("line"), F.explode(names).alias("name"))
