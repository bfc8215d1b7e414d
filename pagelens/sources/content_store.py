"""Content written once in an order that export filters can skip by, and shared by all filters over it.

Rows are dealt out by ranges of (category, time) and sorted so within files, so each row group holds a narrow range of both and
Parquet's own minima and maxima skip the others; a hot category is split by time. Addresses and jobs, which lie in any order,
get bloom filters. `register` remembers stores by what they were made of, so a second filter reads what the first one wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions.checks import parse_date_range
from pagelens.operators.filters import FilterSpec
from pagelens.session import scratch_path, shared_dir, written
from pagelens.sources.tables import list_files

#: Days since 1970, since Parquet's minima of local times are not compared by the reader.
DAY = "scraped_day"
BLOOM = ("job_id", "url")
ROW_GROUP_BYTES = 32 << 20
STORES = "fingerprint string, path string"


def write(content: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """One range shuffle; files and row groups in the order of category and time.

    Finding the ranges reads the rows a second time, so they are written as they come first: their analysis runs once.
    """
    rows = written(content, "content-rows").withColumn(DAY, F.unix_date(F.to_date("scraped_at")))
    order = ["category", DAY, "scraped_at", "content_id"]
    writer = rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", row_group_bytes)
    for name in BLOOM:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.parquet(path)


def matching(spark: SparkSession, path: str, spec: FilterSpec) -> DataFrame:
    """The stored rows that pass a filter; all of its bare comparisons, and the days of its dates, reach the scan."""
    return spark.read.parquet(path).filter(spec.column() & _days(spec)).drop(DAY)


def _days(spec: FilterSpec) -> Column:
    first, last, _ = parse_date_range(spec.values.get("start_date"), spec.values.get("end_date"))
    test = F.lit(True)
    if first:
        test = test & (F.col(DAY) >= F.unix_date(F.lit(first.date())))
    if last:
        test = test & (F.col(DAY) <= F.unix_date(F.lit(last.date())))
    return test


def fingerprint(content: DataFrame, inputs: list[str]) -> str:
    """What a store is made of: the plan of its rows, and name, size and change time of each input file."""
    spark = content.sparkSession
    files = None
    for folder in inputs:
        part = list_files(spark, folder)
        files = part if files is None else files.union(part)
    listed = files.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("key", "size", "modified").cast("decimal(38,0)")).alias("h")
    ).first()
    return f"{content.semanticHash()}-{listed['n']}-{listed['h']}-{content.schema.simpleString()}"


def register(content: DataFrame, inputs: list[str]) -> str:
    """The folder of the store of these rows, written if no finished one is known.

    The list of stores is appended to after the data is written, so an unfinished store is never found. Two callers at the
    same time may both write; both stores are whole.
    """
    spark, known = content.sparkSession, f"{shared_dir(content.sparkSession)}/pagelens/content-stores"
    mark = fingerprint(content, inputs)
    spark.createDataFrame([], STORES).write.mode("append").parquet(known)
    found = spark.read.schema(STORES).parquet(known).filter(F.col("fingerprint") == mark).select("path").limit(1).collect()
    if found:
        return found[0]["path"]
    path = scratch_path(spark, "content")
    write(content, path)
    spark.createDataFrame([(mark, path)], STORES).coalesce(1).write.mode("append").parquet(known)
    return path
