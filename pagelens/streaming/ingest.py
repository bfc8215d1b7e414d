"""Incremental ingest and live progress with the same expressions as the batch jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DataType, IntegerType, StringType, StructField, StructType

from pagelens.functions.checks import content_rejection, url_rejection
from pagelens.functions.html import parse_pages
from pagelens.sources.tables import SCHEMAS


def landed(spark: SparkSession, path: str, table: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over Parquet files as they land, with the declared schema.

    The path is given as a pattern, which admits one file as well as a folder of files.
    """
    reader = spark.readStream.schema(SCHEMAS[table])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def page_rows(pages: DataFrame) -> DataFrame:
    """Parsed and validated page rows; works on a stream and on a table alike."""
    parsed = parse_pages(pages, ("title", "text_content"))
    return parsed.select(
        "page_id",
        "url",
        "title",
        "text_content",
        "word_count",
        F.coalesce(url_rejection(F.col("url")), content_rejection(F.col("text_content")), "error").alias("error"),
    )


def ingest_pages(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append parsed pages to a table; each landed file is processed once."""
    return (
        page_rows(pages)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def without_cancelled(rows: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Rows of jobs that are not in the cancellation table; a stream-static anti-join."""
    return rows.join(cancelled.select("job_id"), "job_id", "left_anti")


def progress(rows: DataFrame) -> DataFrame:
    """R2: processed and failed so far per job; state holds one row per job."""
    return rows.groupBy("job_id").agg(
        F.count(F.when(~F.col("failed"), 1)).alias("processed_urls"),
        F.count(F.when(F.col("failed"), 1)).alias("failed_urls"),
    )


def publish_progress(rows: DataFrame, notify: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """R2: hand each batch's changed job rows to a callback."""
    return (
        progress(rows)
        .writeStream.outputMode("update")
        .foreachBatch(notify)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def once_per_key(rows: DataFrame, key: str, ts: str | None = None, delay: str = "1 day") -> DataFrame:
    """R5 in stream state: one row per key on replay. With an event time, state older than `delay` is released, and a row
    later than that is lost; `take_new` loses none."""
    if ts is None:
        return rows.dropDuplicates([key])
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


#: Folders that a batch of keys is dealt to.
KEY_BUCKETS = 64


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int").alias("bucket")


def known_keys(spark: SparkSession, store: str, kind: DataType, buckets: Sequence[int] | None = None) -> DataFrame:
    """(key, batch, bucket) of the store; with `buckets`, only their folders are read."""
    schema = StructType([StructField("key", kind), StructField("batch", StringType()), StructField("bucket", IntegerType())])
    # The empty batch makes the folder readable from the start; writing it again changes nothing.
    spark.createDataFrame([], StructType(schema.fields[:1])).write.mode("ignore").parquet(f"{store}/batch=none/bucket=0")
    rows = spark.read.schema(schema).parquet(store)
    return rows if buckets is None else rows.filter(F.col("bucket").isin(*buckets))


def take_new(rows: DataFrame, key: str, store: str, out: str, checkpoint: str, stream: str, buckets: int = KEY_BUCKETS) -> StreamingQuery:
    """Append the rows whose key no earlier batch had to `out`, however late they come; one row of each key.

    The keys taken so far lie in `store`, a folder for each batch and, in it, for each bucket of keys. A batch is joined with the buckets
    that its own keys touch. Its rows and keys go to folders named after `stream` and the batch, and its own folders are never
    read as known keys: a batch that is repeated after a failure finds what it found before and overwrites what it wrote.
    `stream` names this query's checkpoint; a store has one running stream at a time. A null key is a key.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark, tag = batch.sparkSession, f"{stream}-{number:09d}"
        own = batch.dropDuplicates([key]).withColumn("bucket", _bucket(key, buckets)).persist()
        try:
            touched = [r["bucket"] for r in own.select("bucket").distinct().collect()]  # at most `buckets` numbers
            known = known_keys(spark, store, batch.schema[key].dataType, touched or [0]).filter(F.col("batch") != tag)
            known = known.select(F.col("key").alias("__key"), F.col("bucket").alias("__bucket"))
            same = (own["bucket"] == known["__bucket"]) & own[key].eqNullSafe(known["__key"])
            own.join(known, same, "left_anti").drop("bucket").write.mode("overwrite").parquet(f"{out}/batch={tag}")
        finally:
            own.unpersist()
        taken = spark.read.schema(batch.schema).parquet(f"{out}/batch={tag}")
        keys = taken.select(F.col(key).alias("key"), _bucket(key, buckets))
        # One task a bucket, so a batch leaves at most one file in each.
        keys.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={tag}")

    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact_keys(spark: SparkSession, store: str, into: str, kind: DataType, buckets: int = KEY_BUCKETS) -> str:
    """The store's keys as one batch in the new folder `into`, between two streams; many small batches list slowly."""
    keys = known_keys(spark, store, kind).select("key", "bucket").repartition(buckets, "bucket")
    keys.write.mode("overwrite").partitionBy("bucket").parquet(f"{into}/batch=compacted")
    return into


def to_table(rows: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over everything landed so far into a Parquet table."""
    return (
        rows.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
