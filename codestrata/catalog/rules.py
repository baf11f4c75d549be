"""Rules over single texts and paths: roles, display names, statements of SQL, lines around a place, sections."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from ..functions import text as tx
from ..session import read_table
from .base import Registry

R = Registry()

_PATH = "^[a-z]+://[^/?#]*(/[^?#]*)"

# What a path or a file name of each role has in it, in the order in which the rules are asked.
TEST_FOLDERS = ("/test/", "/tests/", "/spec/")
CLI_NAMES, MODEL_NAMES = ("cli", "command", "cmd"), ("model", "schema", "entity", "dto")


def role(path: Column) -> Column:
    """Fine role of a file by its path alone; files that no rule names are utilities."""
    path = F.lower(tx.slashed(path))
    name = tx.base_name(path)
    has = lambda c, words: c.rlike("|".join(words))
    test = has(path, TEST_FOLDERS) | F.startswith(name, F.lit("test_")) | F.endswith(name, F.lit("_test.py")) | (name == "conftest.py")
    return F.when(test, "test").when(has(name, CLI_NAMES), "cli_parser").when(has(name, MODEL_NAMES), "data_model").otherwise("utility")


def coarse(fine: Column) -> Column:
    return F.when(fine.isin("test", "non_code"), fine).otherwise("production")


@R.query("file_roles", rf"""
WITH p AS (SELECT doc_id, lower(CASE lang WHEN 'en' THEN 'src/' || source || '/tests/a.py' WHEN 'de' THEN 'src/' || source || '_model.py'
 WHEN 'fr' THEN 'src/cmd_' || source || '.py' ELSE 'src/' || source || '.py' END) AS path FROM documents),
n AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM p),
r AS (SELECT doc_id, CASE WHEN regexp_matches(path, '/test/|/tests/|/spec/') OR starts_with(name, 'test_') OR ends_with(name, '_test.py') OR name = 'conftest.py' THEN 'test'
 WHEN regexp_matches(name, 'cli|command|cmd') THEN 'cli_parser' WHEN regexp_matches(name, 'model|schema|entity|dto') THEN 'data_model' ELSE 'utility' END AS role FROM n)
SELECT doc_id, role, CASE WHEN role = 'test' THEN role ELSE 'production' END AS file_type FROM r""")
def file_roles(spark, sf_dir):
    """Role and type of files whose paths are made of a document's language and source."""
    lang, source = F.col("lang"), F.col("source")
    path = (F.when(lang == "en", F.concat(F.lit("src/"), source, F.lit("/tests/a.py"))).when(lang == "de", F.concat(F.lit("src/"), source, F.lit("_model.py")))
            .when(lang == "fr", F.concat(F.lit("src/cmd_"), source, F.lit(".py"))).otherwise(F.concat(F.lit("src/"), source, F.lit(".py"))))
    return read_table(spark, sf_dir, "documents").select("doc_id", role(path).alias("role")).withColumn("file_type", coarse(F.col("role")))


@R.query("display_names", r"""
WITH p AS (SELECT page_id, ltrim(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1), '/') AS path FROM pages),
b AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS base FROM p), n AS (SELECT *, count(*) OVER (PARTITION BY base) AS n FROM b)
SELECT page_id, CASE WHEN n <= 1 THEN base WHEN contains(path, '/') THEN regexp_extract(path, '([^/]*/[^/]*)$', 1) ELSE path END AS name FROM n""")
def display_names(spark, sf_dir):
    """A page's base name, with the folder before it where another page has the same one."""
    path = F.ltrim(F.regexp_extract("url", _PATH, 1), F.lit("/"))
    rows = read_table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("base", tx.base_name(F.col("path")))
    # joined with one row for each base name that is not unique, so a hot one isn't brought into one window
    twice = rows.groupBy("base").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("base", F.lit(True).alias("twice"))
    longer = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", -2)).otherwise(F.col("path"))
    return rows.join(twice, "base", "left").select("page_id", F.when(F.coalesce("twice", F.lit(False)), longer).otherwise(F.col("base")).alias("name"))


# How a statement of SQL begins, and the words of which it has one.
SQL_VERB = (r"(?i)^\s*\(?\s*(?:with\b[\s\S]*?\bselect\b|select\b|insert\s+into\b|replace\s+into\b|update\b|delete\s+from\b|truncate\s+table\b|"
            r"drop\s+(?:table|index|view|database)\b|alter\s+table\b|create\s+(?:table|index|view|database)\b)")
SQL_CLAUSE = r"(?i)\b(?:from|set|values|where|join|into)\b"


def like_sql(text: Column) -> Column:
    """Whether a text has the shape of a statement: a leading verb and a clause's word."""
    return text.rlike(SQL_VERB) & text.rlike(SQL_CLAUSE)


@R.query("sql_shapes", rf"""
SELECT conv_id, turn, regexp_matches(text, '{SQL_VERB}') AND regexp_matches(text, '{SQL_CLAUSE}') AS like_sql FROM conversations""")
def sql_shapes(spark, sf_dir):
    """Turns whose text looks like a statement of SQL."""
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", like_sql(F.col("text")).alias("like_sql"))


@R.query("context_lines", r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
h AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS line FROM l)
SELECT doc_id, CAST(line AS INTEGER) AS line, array_to_string(lines[line:line + 5], chr(10)) AS context FROM h WHERE contains(lower(lines[line]), 'license')""")
def context_lines(spark, sf_dir):
    """Six lines from each one that speaks of a license."""
    lines = F.split("text", "\n")
    at = F.filter(F.transform(lines, lambda x, i: F.when(F.contains(F.lower(x), F.lit("license")), i + 1)), lambda i: i.isNotNull())
    found = read_table(spark, sf_dir, "documents").filter(F.contains(F.lower("text"), F.lit("license"))).select("doc_id", lines.alias("lines"), F.explode(at).alias("line"))
    return found.select("doc_id", "line", F.array_join(F.slice("lines", F.col("line"), F.lit(6)), "\n").alias("context"))


@R.query("section_lines", r"""
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations),
s AS (SELECT *, max(CASE WHEN ends_with(trim(line), ':') THEN pos END) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS head FROM l)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, CAST(head AS INTEGER) AS head, CAST(pos - head AS INTEGER) AS since FROM s""")
def section_lines(spark, sf_dir):
    """For each line of a turn the last header, a line ending in a colon, up to it, and the lines since."""
    lines = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("pos", F.col("pos") + 1)
    upto = Window.partitionBy("conv_id", "turn").orderBy("pos")         # the lines of one text
    head = F.max(F.when(F.endswith(F.trim("line"), F.lit(":")), F.col("pos"))).over(upto)
    return lines.select("conv_id", "turn", F.col("pos").cast("int").alias("pos"), head.cast("int").alias("head")).withColumn(
        "since", (F.col("pos") - F.col("head")).cast("int"))


# How sure a finding is by its description; the first that it has counts.
PRIORS = {"Hardcoded": 0.6, "[Intentional Pattern]": 0.95, "shell=True": 0.99, "eval(": 0.9, "exec(": 0.9}


def prior(description: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(description, F.lit(k)), v) for k, v in PRIORS.items()], F.lit(0.8))


_DESCRIBED = "CASE event_type WHEN 'error' THEN 'Hardcoded value' WHEN 'click' THEN 'Use of shell=True' WHEN 'view' THEN 'call of eval(x)' ELSE event_type END"


@R.query("finding_priors", f"""WITH d AS (SELECT event_id, {_DESCRIBED} AS d FROM events)
SELECT event_id, CAST(CASE WHEN contains(d, 'Hardcoded') THEN 0.6 WHEN contains(d, '[Intentional Pattern]') THEN 0.95 WHEN contains(d, 'shell=True') THEN 0.99
WHEN contains(d, 'eval(') OR contains(d, 'exec(') THEN 0.9 ELSE 0.8 END AS DOUBLE) AS confidence FROM d""")
def finding_priors(spark, sf_dir):
    """How sure each finding is before anything is known of its data."""
    return read_table(spark, sf_dir, "events").select("event_id", prior(F.expr(_DESCRIBED)).alias("confidence"))
