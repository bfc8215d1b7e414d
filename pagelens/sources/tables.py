"""Table readers and the views that give the given tables the content-store shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions.checks import content_rejection
from pagelens.functions.text import strip

# Declared schemas: nothing is inferred from data.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality bigint, toxic bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "benchmark": "item_id bigint, text string",
}
EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One landed table; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def epoch_plus(seconds: Column) -> Column:
    """Fixed epoch plus a number of seconds, as a zone-free timestamp."""
    return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")
    )


def content_base(documents: DataFrame) -> DataFrame:
    """`content` without analyses: source becomes the job, the first sentence piece the title."""
    return documents.select(
        F.col("doc_id").alias("content_id"),
        F.concat(F.lit("job_"), "source").alias("job_id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("url"),
        strip(F.regexp_extract("text", r"^[^.!?\n]*", 0)).alias("title"),
        F.col("text").alias("content"),
        epoch_plus(F.col("doc_id")).alias("scraped_at"),
        F.lit("static").alias("engine"),
        content_rejection(F.col("text")).alias("error"),
    )


def job_rows(documents: DataFrame) -> DataFrame:
    """Skinny rows for job counters: no text leaves the scan stage."""
    reason = content_rejection(F.col("text"))
    return documents.select(
        F.col("doc_id").alias("content_id"),
        F.concat(F.lit("job_"), "source").alias("job_id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("url"),
        epoch_plus(F.col("doc_id")).alias("at"),
        reason.isNotNull().alias("failed"),
        reason.alias("reason"),
    )


def url_lists(pages: DataFrame) -> DataFrame:
    """Batches of addresses as newline text: the raw link targets of each page plus the page itself."""
    from pagelens.functions.html import hrefs, without_code

    found = hrefs(without_code(F.col("html")))
    return pages.select(
        F.col("page_id").alias("batch_id"),
        F.col("url").alias("page_url"),
        F.concat_ws("\n", F.concat(F.array("url"), found)).alias("urls_text"),
    )


def listed_urls(lists: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """S3: newline text to trimmed, non-empty addresses with their position in the batch."""
    lines = F.filter(F.transform(F.split("urls_text", "\n", -1), strip), lambda u: u != "")
    return (
        lists.select("batch_id", *keep, F.posexplode_outer(lines).alias("i", "url"))
        .select("batch_id", *keep, (F.col("i") + 1).cast("bigint").alias("position"), "url")
        .filter("url IS NOT NULL")
    )


def run_sql(spark: SparkSession, views: dict[str, DataFrame], query: str, args: dict | None = None) -> DataFrame:
    """Parameterised SQL over registered views; arguments are bound, never spliced into the text."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query, args=args or {})


def new_categories(seed: DataFrame, existing: DataFrame) -> DataFrame:
    """Seed rows whose name is not stored yet."""
    return seed.join(existing, "name", "left_anti")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Key, size and change time of every file below a folder; file content is never read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select(
            F.col("path").alias("key"),
            F.col("length").alias("size"),
            F.col("modificationTime").cast("timestamp_ntz").alias("modified"),
        )
    )
