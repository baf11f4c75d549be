"""A corpus pipeline: documents in, token ids of the documents worth training on out.

Each stage takes (spark, docs, sf_dir) and returns what the next one gets; between two
stages lies a Parquet table. Every row is judged by its own text, language and source, also
where its doc_id is null or repeated; only the second stage takes rows of one doc_id for
one document, of which it leaves one row, the first by a hash of the row. A null doc_id is
a document that no stage groups with another one. Equal rows share every verdict of the first stage.
Tables without rows and texts that are null or empty give no rows in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codestrata.llm import bpe, decontaminate, jaccard_join, quality_rules, substrings
from codestrata.llm.catalog import vocabulary
from codestrata.session import materialize, read_table


def row_key() -> Column:
    """128 bits that tell rows of documents apart by all that a stage looks at."""
    what = ("doc_id", "lang", "source", "text")
    # a null hashes as nothing, so which columns are null is hashed, too
    null = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in what])
    return F.struct(F.xxhash64(null, *what).alias("a"), F.xxhash64(F.lit(1), null, *what).alias("b"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go."""
    keyed = docs.withColumn("_row", row_key())
    kept = quality_rules.judge(keyed, key="_row").filter("kept").select(F.col("doc_id").alias("_row"))
    return keyed.join(kept, "_row", "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at 80 percent, the one with the least doc_id stays."""
    joined = jaccard_join.join_documents(docs, width=5, percent=80)
    lead = joined.filter("doc_id = component_id").select("doc_id")
    stay = docs.join(lead, "doc_id", "left_semi")
    first = Window.partitionBy("doc_id").orderBy("_row")
    one = stay.withColumn("_row", row_key()).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return one.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of words that an earlier document has go; a document that loses all its words goes."""
    got = substrings.dedup(docs)
    cut = F.col("dedup.n_removed") > 0
    new = got.withColumn("text", F.when(cut, F.col("dedup.kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return new.filter(~cut | (F.col("dedup.n_removed") < F.col("dedup.n_words"))).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go."""
    return decontaminate.without_items(docs, read_table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text they decode to."""
    return bpe.encode_documents(docs, vocabulary())


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

# SQL can't express the robust estimates of the first stage; a test compares the other stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
