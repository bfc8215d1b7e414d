"""Job, category, source, session and metric reports.

Reports start from small pre-aggregates: one partial aggregate over the content
rows, then everything else on its few result rows. Totals are attached as scalar
subqueries, so no global window and no cross join is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions.quality import four_level
from pagelens.functions.text import rounded
from pagelens.operators.skew import numbered
from pagelens.session import scratch_path


def job_counters(content: DataFrame) -> DataFrame:
    """A1 and A2: counters, start, end and duration per job from (job_id, failed, at) rows."""
    return (
        content.groupBy("job_id")
        .agg(
            F.count(F.lit(1)).alias("total_urls"),
            F.count(F.when(~F.col("failed"), 1)).alias("processed_urls"),
            F.count(F.when(F.col("failed"), 1)).alias("failed_urls"),
            F.min("at").alias("start_time"),
            F.max("at").alias("end_time"),
        )
        .withColumn(
            "duration",
            F.timestamp_diff("SECOND", F.col("start_time"), F.col("end_time")).cast("bigint"),
        )
    )


def job_status(jobs: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Status from the counters and a cancellation table (job_id)."""
    flags = cancelled.select("job_id", F.lit(True).alias("is_cancelled")).distinct()
    done = F.col("processed_urls") + F.col("failed_urls") >= F.col("total_urls")
    status = (
        F.when(F.coalesce("is_cancelled", F.lit(False)), "cancelled")
        .when((F.col("total_urls") == 0) | (done & (F.col("processed_urls") == 0)), "failed")
        .when(done, "completed")
        .when(F.col("processed_urls") + F.col("failed_urls") > 0, "running")
        .otherwise("pending")
    )
    return jobs.join(flags, "job_id", "left").withColumn("status", status).drop("is_cancelled")


def job_errors(content: DataFrame) -> DataFrame:
    """A1: error messages as rows keyed by job, never one list per job."""
    return content.filter("failed").select("job_id", "content_id", F.concat_ws(": ", "reason", "url").alias("message"))


def job_cube(content: DataFrame) -> DataFrame:
    """Counts and sums per job, category and sentiment: the base of A3-A8, A13 and the exports."""
    return content.groupBy("job_id", "category", "sentiment").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("word_count").alias("words"),
        F.sum("quality_score").alias("quality"),
        F.min("content_id").alias("first_id"),
    )


def job_statistics(cube: DataFrame) -> DataFrame:
    """A3 totals: pages, words, mean words and mean quality per job."""
    return (
        cube.groupBy("job_id")
        .agg(F.sum("n").alias("pages"), F.sum("words").alias("total_words"), F.sum("quality").alias("q"))
        .select(
            "job_id",
            "pages",
            "total_words",
            (F.col("total_words").cast("double") / F.col("pages").cast("double")).alias("avg_words"),
            F.floor(F.col("total_words") / F.col("pages")).cast("bigint").alias("avg_words_floor"),
            F.round(F.col("q") / F.col("pages"), 6).alias("avg_quality"),
        )
    )


def job_distributions(cube: DataFrame) -> DataFrame:
    """A3 distributions as rows (job, kind, value, n): categories and sentiments in one pass over the cube."""
    both = cube.select(
        "job_id",
        "n",
        F.explode(
            F.array(
                F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")),
                F.struct(F.lit("sentiment").alias("kind"), F.col("sentiment").alias("value")),
            )
        ).alias("x"),
    )
    return both.groupBy("job_id", "x.kind", "x.value").agg(F.sum("n").alias("n"))


def report_overview(cube: DataFrame) -> DataFrame:
    """A4: totals and the most common category per job; first seen wins ties, `Unknown` when missing."""
    named = cube.withColumn("category", F.coalesce("category", F.lit("Unknown")))
    per = named.groupBy("job_id", "category").agg(
        F.sum("n").alias("n"), F.sum("words").alias("words"), F.min("first_id").alias("first_id")
    )
    return (
        per.groupBy("job_id")
        .agg(
            F.sum("n").alias("total_results"),
            F.sum("words").alias("total_words"),
            F.max_by("category", F.struct("n", -F.col("first_id"))).alias("most_common_category"),
        )
        .withColumn("avg_words", rounded(F.col("total_words") / F.col("total_results"), 1))
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts per value with their share of the total in percent."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.select(F.count(F.lit(1)).cast("double").alias("t"))
    return counts.withColumn("percent", rounded(F.col("n") * 100.0 / total.scalar(), 1)).orderBy(F.desc("n"), "value")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between the minimum and maximum, with the mean beside them."""
    c = F.col(column)
    low = df.select(F.min(c).alias("v")).scalar()
    high = df.select(F.max(c).alias("v")).scalar()
    mean = df.select(F.round(F.avg(c), 6).alias("v")).scalar()
    bounded = df.select(c.cast("double").alias("v"), low.alias("low"), high.alias("high")).filter("v IS NOT NULL")
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    bin_of = F.when(F.col("high") == F.col("low"), F.lit(1)).otherwise(
        F.least(F.floor((F.col("v") - F.col("low")) / width) + 1, F.lit(bins))
    )
    return (
        bounded.groupBy(bin_of.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("mean", mean)
    )


def latest_job(jobs: DataFrame) -> DataFrame:
    """The job that started last; a top-1 sort, not a global window."""
    return jobs.orderBy(F.desc("start_time"), "job_id").limit(1)


def top_values(counts: DataFrame, group: Sequence[str], k: int) -> DataFrame:
    """The k most frequent values per group; the limit is applied before the shuffle too."""
    w = W.partitionBy(*group).orderBy(F.desc("n"), "first_id")
    return counts.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def job_insight(cube: DataFrame, job_id: str | Column) -> DataFrame:
    """Report lines (section, ord, line) for one job, from its few cube rows."""
    # A few rows, written once: four parts of the report read them.
    path = scratch_path(cube.sparkSession, "insight")
    cube.filter(F.col("job_id") == job_id).write.parquet(path)
    one = cube.sparkSession.read.parquet(path)
    totals = one.agg(
        F.sum("n").alias("pages"), F.sum("words").alias("words"), F.sum("quality").alias("q")
    ).select(
        "pages",
        "words",
        F.floor(F.col("words") / F.col("pages")).cast("bigint").alias("avg_words"),
        F.round(F.col("q") / F.col("pages"), 6).alias("quality"),
    )
    pages = totals.select("pages").scalar().cast("double")

    def shares(kind: str, section: int, k: int | None) -> DataFrame:
        counts = one.groupBy(kind).agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
        ranked = counts.withColumn("ord", F.row_number().over(W.orderBy(F.desc("n"), "first_id")))
        if k:
            ranked = ranked.filter(F.col("ord") <= k)
        percent = rounded(F.col("n") * 100.0 / pages, 1)
        line = F.concat(F.col(kind), F.lit(": "), F.col("n").cast("string"), F.lit(" pages, "), percent.cast("string"), F.lit("%"))
        return ranked.select(F.lit(section).cast("bigint").alias("section"), F.col("ord").cast("bigint").alias("ord"), line.alias("line"))

    q = F.col("quality")
    overview = totals.select(
        F.posexplode(
            F.array(
                F.concat(F.lit("pages: "), F.col("pages").cast("string")),
                F.concat(F.lit("words: "), F.col("words").cast("string")),
                F.concat(F.lit("average words: "), F.col("avg_words").cast("string")),
                F.concat(F.lit("quality level: "), four_level(q, "Needs Improvement")),
                F.concat(
                    F.lit("quality is "),
                    F.when(q > 0.6, "above average").when(q > 0.4, "average").otherwise("below average"),
                ),
                F.when(F.col("avg_words") > 300, "word counts are good").otherwise("longer content is advised"),
                F.when(q > 0.7, "keep current quality").otherwise("work on quality"),
                F.when(F.col("avg_words").between(300, 1000), "length is optimal").otherwise("adjust content length"),
            )
        ).alias("ord", "line")
    ).select(F.lit(1).cast("bigint").alias("section"), (F.col("ord") + 1).cast("bigint").alias("ord"), "line")
    return overview.union(shares("category", 2, 3)).union(shares("sentiment", 3, None))


def status_rollup(jobs: DataFrame, content_count: Column) -> DataFrame:
    """Job counts by state with processed addresses and analysed contents."""
    s = F.col("status")
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count(F.when(s.isin("running", "started"), 1)).alias("active_jobs"),
        F.count(F.when(s == "completed", 1)).alias("completed_jobs"),
        F.count(F.when(s == "failed", 1)).alias("failed_jobs"),
        F.sum("processed_urls").alias("total_urls_processed"),
    ).withColumn("total_content_analyzed", content_count)


def job_progress(jobs: DataFrame, content: DataFrame) -> DataFrame:
    """A10: done/total, remaining and stored results for jobs under way or done."""
    stored = content.groupBy("job_id").agg(F.count(F.lit(1)).alias("results_count"))
    return (
        jobs.filter(F.col("status").isin("running", "started", "completed"))
        .join(stored, "job_id", "left")
        .select(
            "job_id",
            "status",
            F.concat_ws("/", F.col("processed_urls").cast("string"), F.col("total_urls").cast("string")).alias("progress"),
            (F.col("total_urls") - F.col("processed_urls")).alias("urls_remaining"),
            F.coalesce("results_count", F.lit(0)).alias("results_count"),
        )
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def category_rollup(cube: DataFrame, categories: DataFrame) -> DataFrame:
    """Content count and mean quality for every listed category, used or not."""
    per = cube.groupBy(F.col("category").alias("name")).agg(F.sum("n").alias("n"), F.sum("quality").alias("q"))
    return categories.join(F.broadcast(per), "name", "left").select(
        "name",
        F.coalesce("n", F.lit(0)).alias("content_count"),
        F.round(F.col("q") / F.col("n"), 6).alias("avg_quality_score"),
    )


def session_rollup(events: DataFrame) -> DataFrame:
    """Jobs, fetched addresses and last activity per session; a hot user is pre-aggregated map-side."""
    return events.groupBy(F.col("user_id").cast("string").alias("session_id")).agg(
        F.count(F.lit(1)).alias("jobs_count"),
        F.count(F.when(F.col("event_type") == "view", 1)).alias("urls_scraped"),
        F.max("ts").alias("last_activity"),
    )


def metric_series(events: DataFrame, unit: str = "DAY") -> DataFrame:
    """Metric values over time with a number read from the JSON context."""
    return events.groupBy(
        F.col("event_type").alias("metric_name"),
        F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("period"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("value"), 6).alias("avg_value"),
        F.max("value").alias("max_value"),
        F.sum(F.get_json_object("props", "$.k").try_cast("bigint")).alias("context_sum"),
    )


def source_comparison(content: DataFrame) -> DataFrame:
    """Volume, words and quality per source."""
    return content.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("word_count").alias("words"),
        F.round(F.avg("word_count"), 6).alias("avg_words"),
        F.round(F.avg("quality_score"), 6).alias("avg_quality"),
    )


def paging(page: object, size: object, max_size: int = 1000) -> tuple[int, int, str | None]:
    """Usable page and size, and what was wrong with a size that had to be cut."""
    page = page if isinstance(page, int) and page >= 1 else 1
    size = size if isinstance(size, int) and size >= 1 else 10
    error = f"a page holds at most {max_size} rows, not {size}" if size > max_size else None
    return page, min(size, max_size), error


def page_of(df: DataFrame, order: Sequence[str], page: int = 1, size: int = 10, max_size: int = 1000) -> DataFrame:
    """One page of ordered rows; `paging` says what it makes of odd numbers."""
    page, size, _ = paging(page, size, max_size)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def batches(content: DataFrame, size: int = 5) -> DataFrame:
    """Batch number inside each job with running processed and failed counts; no job-wide window."""
    return numbered(
        content.select("job_id", "content_id", "failed"),
        "content_id",
        ["job_id"],
        {
            "processed_so_far": F.when(~F.col("failed"), 1).otherwise(0).cast("bigint"),
            "failed_so_far": F.when(F.col("failed"), 1).otherwise(0).cast("bigint"),
        },
    ).withColumn("batch", F.floor((F.col("position") - 1) / size).cast("bigint"))
