"""Tables fed as streams of files, and streams run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder


def new_folder(spark: SparkSession, label: str) -> str:
    return "/".join([shared_folder(spark), "codestrata", spark.sparkContext.applicationId, f"{label}-{uuid.uuid4().hex[:12]}"])


def feed(events: DataFrame, slices: int, close_after: int | None = None) -> DataFrame:
    """A stream of ``events`` (event_id, key, us and more), in files written one slice of time after another.

    The stream has a column ts, the event's time. ``close_after``: so many microseconds behind the last event one
    with null fields closes the input, which lets timers of the others run out. Events without a time are left out.
    """
    spark = events.sparkSession
    path = new_folder(spark, "feed")
    events = events.filter("us is not null")
    ends = events.agg(F.min("us").alias("lo"), F.max("us").alias("hi")).first()
    lo, hi = ends.lo or 0, ends.hi or 0
    width = (hi - lo) // slices + 1
    for k in range(slices):
        events.filter((F.col("us") >= lo + k * width) & (F.col("us") < lo + (k + 1) * width)).write.mode("append").parquet(path)
    if close_after is not None:
        last = events.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name != "us"])
        spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in last.schema],
                              F.lit(hi + close_after).alias("us")).select(*events.columns).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 64).parquet(path).withColumn("ts", F.timestamp_micros("us"))


def drained(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream of appended rows over all that its source has, and read what the sink got."""
    spark = stream.sparkSession
    path = new_folder(spark, label)
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows")
             .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def drained_updates(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Run a stream of updated rows over all that its source has; the last row of each key.

    A batch that is run again after a failure writes over its own rows.
    """
    spark = stream.sparkSession
    path = new_folder(spark, label)

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/rows/{batch}")

    query = (stream.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    got = spark.createDataFrame([], stream.schema).withColumn("_batch", F.lit(0).cast("long"))
    got = spark.read.schema(got.schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")
    rest = [c for c in stream.columns if c not in keys]
    return got.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_x")).select(*keys, *[f"_x.{c}" for c in rest])
