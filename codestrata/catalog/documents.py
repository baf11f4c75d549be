"""Line, duplicate and text-shape queries over the given text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..plans import duplicates as dup
from ..session import read_table
from .base import Registry

R = Registry()

_BREAK = tx.LINE_BREAK
_BLANK = tx.BLANK

# lines of every document, normalized, with position; shared by the SQL checks
SQL_LINES = rf"""
raw AS (SELECT doc_id AS file, string_split_regex(text, '{_BREAK}') AS parts FROM documents),
cut AS (SELECT file, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts FROM raw),
line AS (SELECT file, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM cut),
stripped AS (SELECT file, pos, regexp_replace(split_part(line, '#', 1), '^{_BLANK}+|{_BLANK}+$', '', 'g') AS line FROM line),
norm AS (SELECT file, pos, lower(regexp_replace(regexp_replace(line, '".*?"', '""', 'g'), '''.*?''', '''''', 'g')) AS line FROM stripped)
"""

SQL_BLOCKS = SQL_LINES + r""",
keep AS (SELECT file, line, row_number() OVER (PARTITION BY file ORDER BY pos) AS rn FROM norm WHERE length(line) > 3),
win AS (SELECT file, rn, string_agg(line, chr(10)) OVER w AS block, count(*) OVER w AS n FROM keep
        WINDOW w AS (PARTITION BY file ORDER BY rn ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
blk AS (SELECT file, md5(block) AS block FROM win WHERE n = 6)
"""


def document_files(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content"))


@R.query("line_counts", rf"""
WITH raw AS (SELECT doc_id, string_split_regex(text, '{_BREAK}') AS parts FROM documents)
SELECT doc_id, CAST(CASE WHEN parts[-1] = '' THEN len(parts) - 1 ELSE len(parts) END AS INTEGER) AS n_lines FROM raw
""")
def line_counts(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", tx.line_count(F.col("text")).alias("n_lines"))


@R.query("normalized_lines", f"WITH {SQL_LINES} SELECT file AS doc_id, CAST(pos AS INTEGER) AS pos, line FROM norm")
def normalized_lines(spark, sf_dir):
    docs = document_files(spark, sf_dir)
    return docs.select("file", F.posexplode(tx.lines_of(F.col("content"))).alias("pos", "line")).select(
        F.col("file").alias("doc_id"), (F.col("pos") + 1).cast("int").alias("pos"),
        tx.normalize_line(F.col("line")).alias("line"))


@R.query("file_digests", "SELECT doc_id, md5(text) AS digest FROM documents")
def file_digests(spark, sf_dir):
    return document_files(spark, sf_dir).select(F.col("file").alias("doc_id"), F.md5("content").alias("digest"))


@R.query("block_windows", f"""WITH {SQL_BLOCKS}
SELECT file AS doc_id, CAST(count(*) AS INTEGER) AS windows, CAST(count(DISTINCT block) AS INTEGER) AS distinct_blocks
FROM blk GROUP BY file""")
def block_windows(spark, sf_dir):
    return dup.block_sets(document_files(spark, sf_dir)).select(
        F.col("file").alias("doc_id"), "windows", F.size("blocks").alias("distinct_blocks"))


@R.query("exact_duplicates", """
WITH h AS (SELECT doc_id, md5(text) AS d FROM documents), f AS (SELECT d, min(doc_id) AS file1 FROM h GROUP BY d)
SELECT file1, doc_id AS file2 FROM h JOIN f USING (d) WHERE doc_id <> file1""")
def exact_duplicates(spark, sf_dir):
    return dup.exact_stars(document_files(spark, sf_dir))


# every pair of files by the rule itself, over all files' blocks; leaders only name the groups
SQL_PAIRS = SQL_BLOCKS + r""",
tot AS (SELECT file, CAST(count(*) AS INTEGER) AS windows, md5(string_agg(DISTINCT block, ',' ORDER BY block)) AS sig FROM blk GROUP BY file),
doc AS (SELECT doc_id AS file, md5(text) AS d, windows, sig FROM documents LEFT JOIN tot ON file = doc_id),
mem AS (SELECT file, d, CASE WHEN d IS NOT NULL THEN min(file) OVER (PARTITION BY d) END AS content_leader,
        CASE WHEN sig IS NOT NULL THEN min(file) OVER (PARTITION BY sig, windows) END AS block_leader FROM doc),
u AS (SELECT DISTINCT file, block FROM blk),
p AS (SELECT a.file AS file1, b.file AS file2, count(*) AS shared FROM u a JOIN u b ON a.block = b.block AND a.file < b.file GROUP BY 1, 2),
near AS (SELECT file1, file2, CAST(round_even(least(shared / least(t1.windows, t2.windows) * 100, 100), 0) AS INTEGER) AS similarity
         FROM p JOIN doc t1 ON t1.file = file1 JOIN doc t2 ON t2.file = file2 WHERE t1.d <> t2.d),
pair AS (SELECT *, 'block' AS type FROM near WHERE similarity >= 30
         UNION ALL SELECT x.file, y.file, 100, 'exact' FROM doc x JOIN doc y ON x.d = y.d AND x.file < y.file),
both_ways AS (SELECT file1 AS file, file2 AS mate, similarity, type FROM pair UNION ALL SELECT file2, file1, similarity, type FROM pair),
block_rows AS (SELECT DISTINCT least(m1.block_leader, m2.block_leader) AS file1, greatest(m1.block_leader, m2.block_leader) AS file2, similarity
               FROM pair JOIN mem m1 ON m1.file = file1 JOIN mem m2 ON m2.file = file2 WHERE type = 'block')
"""


@R.query("duplicate_membership", f"WITH {SQL_PAIRS} SELECT file, content_leader, block_leader FROM mem")
def duplicate_membership(spark, sf_dir):
    """The group leaders that stand for each file in the rows of the report."""
    return dup.Groups(document_files(spark, sf_dir)).membership.select("file", "content_leader", "block_leader")


@R.query("block_duplicates", f"WITH {SQL_PAIRS} SELECT file1, file2, similarity FROM block_rows")
def block_duplicates(spark, sf_dir):
    """Pairs of group leaders that share blocks; a leader with itself for different contents of its group."""
    return dup.Groups(document_files(spark, sf_dir)).block_rows()


@R.query("duplicate_report", f"""WITH {SQL_PAIRS} SELECT file1, file2, similarity, 'block' AS type FROM block_rows
UNION ALL SELECT content_leader, file, 100, 'exact' FROM mem WHERE file <> content_leader""")
def duplicate_report(spark, sf_dir):
    """Copies and block pairs, most similar first."""
    return dup.Groups(document_files(spark, sf_dir)).report().orderBy(F.desc("similarity"), "file1", "file2", "type")


@R.query("duplicates_by_file", f"""WITH {SQL_PAIRS}
SELECT b.file, CASE type WHEN 'exact' THEN m.content_leader ELSE m.block_leader END AS other, similarity, type, count(*) AS n_files
FROM both_ways b JOIN mem m ON m.file = mate GROUP BY ALL""")
def duplicates_by_file(spark, sf_dir):
    """For every file, copies and members of large groups included, where its duplicates are and how many."""
    return dup.Groups(document_files(spark, sf_dir)).by_file()


@R.query("duplicate_totals", f"""WITH {SQL_PAIRS}
SELECT (SELECT count(*) FROM pair) AS pairs, (SELECT count(DISTINCT file) FROM both_ways) AS files""")
def duplicate_totals(spark, sf_dir):
    return dup.Groups(document_files(spark, sf_dir)).totals()


SQL_SENTENCES = "docs AS (SELECT doc_id, replace(text, '. ', '.' || chr(10)) AS text FROM documents)," + SQL_PAIRS.replace("FROM documents", "FROM docs")


def sentence_files(spark, sf_dir) -> DataFrame:
    """Documents with a line for each sentence; most have few lines of their own."""
    return document_files(spark, sf_dir).withColumn("content", F.replace("content", F.lit(". "), F.lit(".\n")))


@R.query("sentence_duplicates", f"""WITH {SQL_SENTENCES} SELECT file1, file2, similarity, 'block' AS type FROM block_rows
UNION ALL SELECT content_leader, file, 100, 'exact' FROM mem WHERE file <> content_leader""")
def sentence_duplicates(spark, sf_dir):
    """As duplicate_report, blocks being six sentences."""
    return dup.Groups(sentence_files(spark, sf_dir)).report()


@R.query("sentence_duplicates_by_file", f"""WITH {SQL_SENTENCES}
SELECT b.file, CASE type WHEN 'exact' THEN m.content_leader ELSE m.block_leader END AS other, similarity, type, count(*) AS n_files
FROM both_ways b JOIN mem m ON m.file = mate GROUP BY ALL""")
def sentence_duplicates_by_file(spark, sf_dir):
    """As duplicates_by_file, blocks being six sentences."""
    return dup.Groups(sentence_files(spark, sf_dir)).by_file()
