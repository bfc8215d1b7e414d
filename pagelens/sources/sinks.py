"""Stored results and exports. Every writer is a distributed write; a path is never rewritten in place."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions.checks import clean_name, preview
from pagelens.functions.text import rounded

FORMATS = ("json", "csv", "parquet", "text")
NO_DATA = "no rows"
#: Texts keep their outer blanks, and quotes are doubled.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
DISPLAY = "URL string, Title string, `Word Count` bigint, Status string, Category string, Sentiment string, `Quality Score` double, `Full Content` string"


def by_job(df: DataFrame) -> DataFrame:
    """Even files per job: small jobs share a task, a hot job is split over several."""
    return df.hint("rebalance", "job_id")


def export_folder(base: str, as_of: datetime, job_id: str | None = None) -> str:
    """Dated folder, with the job below it when given."""
    dated = f"{base.rstrip('/')}/exports/{as_of:%Y/%m/%d}"
    return f"{dated}/{job_id}" if job_id else dated


def export_name(job_id: Column, as_of: datetime, fmt: str) -> Column:
    """Cleaned export name of job, time and format."""
    return clean_name(F.concat(job_id, F.lit(f"_{as_of:%Y%m%d_%H%M%S}.{fmt}")))


def with_export_path(df: DataFrame, as_of: datetime) -> DataFrame:
    """Date columns for a dated, per-job directory layout."""
    return df.withColumns(
        {
            "year": F.lit(f"{as_of:%Y}"),
            "month": F.lit(f"{as_of:%m}"),
            "day": F.lit(f"{as_of:%d}"),
        }
    )


def stored_content(content: DataFrame) -> DataFrame:
    """Content rows with JSON-encoded analyses and metadata counts."""
    return content.select(
        "job_id",
        "content_id",
        "url",
        "title",
        "content",
        "word_count",
        "engine",
        "scraped_at",
        F.to_json(F.struct("sentiment", "compound", "readability_score")).alias("nlp_analysis"),
        F.to_json(F.struct("category", "category_confidence")).alias("classification"),
        "quality_score",
    )


def store_results(jobs: DataFrame, content: DataFrame, path: str) -> None:
    """One job table and one content table partitioned by job."""
    jobs.write.parquet(f"{path}/scraping_jobs")
    by_job(stored_content(content)).write.partitionBy("job_id").parquet(f"{path}/scraped_content")


def job_summary(jobs: DataFrame) -> DataFrame:
    """The eight summary fields."""
    return jobs.select(
        "job_id", "status", "total_urls", "processed_urls", "failed_urls", "start_time", "end_time", "duration"
    )


def export_jobs(jobs: DataFrame, content: DataFrame, errors: DataFrame, path: str, as_of: datetime) -> None:
    """Metadata, summaries, results and errors as JSON lines; results and errors sit below their job."""
    spark = jobs.sparkSession
    meta = [(as_of.isoformat(), "json", "1.0")]
    spark.createDataFrame(meta, "export_time string, format string, version string").write.json(f"{path}/export_metadata")
    job_summary(jobs).write.json(f"{path}/job_summary")
    by_job(content).write.partitionBy("job_id").json(f"{path}/scraping-results")
    by_job(errors).write.partitionBy("job_id").json(f"{path}/errors")


def export_statistics(content: DataFrame, path: str) -> None:
    """Results below their job, and beside them the totals and distributions of each job, as JSON lines.

    The statistics are made of the cube of the written results, so they fit the rows that went out.
    """
    from pagelens.operators import reports

    by_job(content).write.partitionBy("job_id").json(f"{path}/scraped_results")
    written = content.sparkSession.read.schema(RESULT_FIELDS).json(f"{path}/scraped_results")
    reports.job_cube(written).write.parquet(f"{path}/cube")
    cube = content.sparkSession.read.parquet(f"{path}/cube")
    totals = cube.groupBy("job_id").agg(F.sum("n").alias("n"), F.sum("words").alias("total_words"), F.sum("quality").alias("q"))
    totals.select(
        "job_id", "total_words", (F.col("total_words").cast("double") / F.col("n").cast("double")).alias("average_words"), (F.col("q") / F.col("n")).alias("average_quality")
    ).write.json(f"{path}/statistics")
    reports.job_distributions(cube).write.json(f"{path}/distributions")


#: The fields of a written result that statistics are made of, and its job, which is its folder.
RESULT_FIELDS = "content_id bigint, url string, word_count bigint, category string, sentiment string, quality_score double, job_id string"


def read_statistics(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """S9 read back: scraped_results, statistics and distributions."""
    schemas = {
        "scraped_results": RESULT_FIELDS,
        "statistics": "job_id string, total_words bigint, average_words double, average_quality double",
        "distributions": "job_id string, kind string, value string, n bigint",
    }
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def flat_rows(content: DataFrame) -> DataFrame:
    """Base, analysis, classification and quality columns of one flat row."""
    return content.select(
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("word_count", F.lit(0)).alias("word_count"),
        F.col("engine").alias("scraping_engine"),
        "scraped_at",
        preview(F.col("content"), 200, always_mark=True).alias("content_preview"),
        F.col("analysis.sentiment.label").alias("sentiment"),
        F.col("analysis.sentiment.score").alias("sentiment_score"),
        F.col("analysis.language").alias("language"),
        F.col("analysis.readability").alias("readability_score"),
        F.col("analysis.category").alias("category"),
        F.col("classification.predicted_category").alias("predicted_category"),
        F.col("classification.confidence").alias("classification_confidence"),
        "quality_score",
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; an empty table becomes one stated row."""
    if df.isEmpty():
        df = df.sparkSession.createDataFrame([(NO_DATA,)], "message string")
    df.write.options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What `write_csv` wrote, value by value; a null and an empty text are the same in CSV."""
    return spark.read.schema(schema).options(**CSV, multiLine=True).csv(path)


def display_rows(content: DataFrame) -> DataFrame:
    """The eight display columns, with the full content."""
    return content.select(
        F.col("url").alias("URL"),
        F.col("title").alias("Title"),
        F.col("word_count").alias("Word Count"),
        F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("Status"),
        F.col("category").alias("Category"),
        F.col("sentiment").alias("Sentiment"),
        F.col("quality_score").alias("Quality Score"),
        F.col("content").alias("Full Content"),
    )


def sheet_tables(jobs: DataFrame, content: DataFrame, responses: DataFrame, errors: DataFrame) -> dict[str, DataFrame]:
    """The four sheets as tables."""
    return {
        "job_summary": job_summary(jobs),
        "results": content.select(
            "job_id", "url", "title", "word_count", "engine", "scraped_at", "quality_score", "sentiment", "category"
        ),
        "detailed_analysis": responses.select(
            "job_id", "url", F.substring("response", 1, 500).alias("summary"), "response"
        ),
        "errors": errors,
    }


def report_lines(jobs: DataFrame, cube: DataFrame, content: DataFrame) -> DataFrame:
    """Text report as rows (job_id, section, n, part, line): header, statistics, categories, results.

    Sections come from a few job rows, the category cube and one row per result;
    sorting by the first four columns gives the file, however long it is.
    """
    stats = cube.groupBy("job_id").agg(
        F.sum("n").alias("pages"), F.sum("words").alias("words"), F.sum("quality").alias("q")
    )
    base = jobs.join(stats, "job_id")

    def lines(df: DataFrame, section: int, n: Column, parts: list[Column]) -> DataFrame:
        return df.select("job_id", n.cast("bigint").alias("n"), F.posexplode(F.array(*parts)).alias("part", "line")).select(
            "job_id", F.lit(section).cast("bigint").alias("section"), "n", F.col("part").cast("bigint").alias("part"), "line"
        )

    def text(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), F.coalesce(value.cast("string"), F.lit("")))

    header = lines(
        base,
        1,
        F.lit(0),
        [
            F.lit("CONTENT ANALYSIS REPORT"),
            text("Job ID: ", F.col("job_id")),
            text("Status: ", F.col("status")),
            text("Total URLs: ", F.col("total_urls")),
            text("Processed: ", F.col("processed_urls")),
            text("Duration in seconds: ", F.col("duration")),
        ],
    )
    summary = lines(
        base,
        2,
        F.lit(0),
        [
            text("Total Word Count: ", F.col("words")),
            text("Average Words per Page: ", F.floor(F.col("words") / F.col("pages"))),
            text("Average Quality Score: ", rounded(F.col("q") / F.col("pages"), 2)),
        ],
    )
    counts = cube.groupBy("job_id", "category").agg(F.sum("n").alias("k"), F.min("first_id").alias("first_id"))
    shares = counts.join(stats.select("job_id", "pages"), "job_id")
    percent = rounded(F.col("k") * 100.0 / F.col("pages"), 1)
    # Larger counts first, then first seen: the sort key is packed into one number per job.
    categories = lines(
        shares.withColumn("rank", F.row_number().over(_category_order())),
        3,
        F.col("rank"),
        [F.concat(F.col("category"), F.lit(": "), F.col("k").cast("string"), F.lit(" pages, "), percent.cast("string"), F.lit("%"))],
    )
    results = lines(
        content,
        4,
        F.col("content_id"),
        [
            text("", F.col("title")),
            text("   URL: ", F.col("url")),
            text("   Words: ", F.col("word_count")),
            text("   Category: ", F.col("category")),
            text("   Sentiment: ", F.col("sentiment")),
            text("   Quality: ", rounded(F.col("quality_score"), 2)),
            text("   Full Content: ", F.col("content")),
        ],
    )
    return header.union(summary).union(categories).union(results)


def _category_order():
    from pyspark.sql import Window as W

    return W.partitionBy("job_id").orderBy(F.desc("k"), "first_id")


def write_report(lines: DataFrame, path: str) -> None:
    """One ordered text output per job."""
    lines.orderBy("job_id", "section", "n", "part").select("job_id", "line").write.partitionBy("job_id").text(path)


def analysis_summary(content: DataFrame) -> DataFrame:
    """The seven summary columns."""
    return content.select(
        "url", "title", "word_count", "sentiment", "category",
        F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"),
        F.col("scraped_at").alias("analysis_timestamp"),
    )


def metric_rows(metrics: DataFrame) -> DataFrame:
    """Nested (category, map of metric to value) to long rows."""
    return metrics.select("category", F.explode_outer("metrics").alias("metric", "value")).filter("metric IS NOT NULL")


def written_rows(spark: SparkSession, fmt: str, path: str) -> int:
    """Rows of a written export, counted from its files: footers for Parquet, lines for JSON and text."""
    if fmt == "parquet":
        return spark.read.parquet(path).count()
    if fmt == "csv":
        return spark.read.csv(path, header=True, multiLine=True, escape='"').count()
    return spark.read.text(path).count()


def export_table(
    df: DataFrame, fmt: str, path: str, export_id: str, as_of: datetime, metadata: dict[str, str] | None = None,
    job_id: str | None = None,
) -> DataFrame:
    """Write a table with a one-row manifest and return the export log row.

    The record count comes from the written files, so the data is computed once.
    A failed write gives a log row with the error instead of an exception.
    """
    spark = df.sparkSession
    status, error, count, size = "completed", None, 0, 0
    try:
        if fmt not in FORMATS:
            raise ValueError(f"Unsupported format: {fmt}")
        writer = df.write.option("header", True).option("escape", '"') if fmt == "csv" else df.write
        writer.format(fmt).save(f"{path}/data")
        count = written_rows(spark, fmt, f"{path}/data")
        spark.createDataFrame(
            [(metadata or {}, as_of.isoformat(), count)],
            "metadata map<string,string>, export_time string, record_count bigint",
        ).write.json(f"{path}/manifest")
        from pagelens.sources.tables import list_files

        size = int(list_files(spark, f"{path}/data").agg(F.sum("size")).first()[0] or 0)
    except Exception as exc:  # the log row is the result, also for a failed export
        status, error = "failed", str(exc).split("\n")[0]
    row = (export_id, job_id, fmt, path, size, count, status, error, as_of)
    return spark.createDataFrame(
        [row],
        "export_id string, job_id string, export_type string, file_path string, file_size bigint, "
        "record_count bigint, status string, error string, created_at timestamp_ntz",
    )
