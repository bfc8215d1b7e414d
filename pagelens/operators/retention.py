"""Retention: what expires, and what stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expired_jobs(jobs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Completed jobs that ended more than `days` before `as_of`."""
    cutoff = as_of - F.make_dt_interval(F.lit(days))
    return jobs.filter((F.col("status") == "completed") & (F.col("end_time") < cutoff))


def without_expired(rows: DataFrame, expired: DataFrame) -> DataFrame:
    """Rows whose job stays; the same anti-join serves jobs and their content."""
    return rows.join(expired.select("job_id"), "job_id", "left_anti")


def expired_files(files: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Files last changed more than `days` before `as_of`. Deleting them is left to the store's lifecycle rules."""
    return files.filter(F.col("modified") < as_of - F.make_dt_interval(F.lit(days)))


def file_statistics(files: DataFrame) -> DataFrame:
    """Files, bytes and megabytes per lower-cased extension."""
    ext = F.lower(F.regexp_extract("key", r"(\.[^./]+)$", 1))
    return files.groupBy(ext.alias("extension")).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("bytes"),
        F.round(F.sum("size") / (1024 * 1024), 2).alias("megabytes"),
    )
