"""Per-file results kept in a store, of which a later run replaces those of changed files only.

The store is a Parquet table of one row for each file, laid out by a hash of the file. A refresh works on
the changed files' rows and rewrites the buckets that hold them; figures over all files are added up from the store,
so they equal those of a run over everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize

BUCKETS = 64


def _laid(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(BUCKETS)).cast("int"))


def create(rows: DataFrame, path: str) -> None:
    """A store of ``rows``, one for each file."""
    _laid(rows).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows."""
    # buckets that lost all their files hold a row without one
    return spark.read.parquet(path).drop("bucket").filter("file is not null")


def refresh(path: str, changed: DataFrame, fresh: DataFrame) -> None:
    """Replace the rows of ``changed`` files (column file) by those ``fresh`` has for them; none means the file is gone.

    Rows of ``fresh`` for other files are passed over. Running it again changes nothing, so a refresh that failed half way
    is run again. With no changed file nothing is written.
    """
    spark = changed.sparkSession
    which = materialize(_laid(changed.select("file").filter("file is not null").distinct()), "changed-files")
    touched = [r.bucket for r in which.select("bucket").distinct().collect()]       # BUCKETS at most
    if not touched:
        return
    names = which.select("file")
    stored = spark.read.parquet(path)
    kept = stored.filter(F.col("bucket").isin(touched)).join(names, "file", "left_anti")
    new = materialize(kept.unionByName(_laid(fresh.join(names, "file", "left_semi")).select(*kept.columns)), "refreshed")
    # a bucket whose files are all gone has no row to write over it, so it is emptied by a row that is then left out
    empty = spark.createDataFrame([(b,) for b in touched], "bucket int").join(new.select("bucket").distinct(), "bucket", "left_anti")
    blank = empty.select(*[F.col("bucket") if f.name == "bucket" else F.lit(None).cast(f.dataType).alias(f.name) for f in new.schema])
    new.unionByName(blank).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
