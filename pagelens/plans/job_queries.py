"""Queries over jobs and content: counters, reports, joins, exports, retention, sessions, metrics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagelens import seeds
from pagelens.functions import checks, quality
from pagelens.operators import reports as rp
from pagelens.operators import retention as rt
from pagelens.functions.text import rounded
from pagelens.operators.filters import FilterSpec
from pagelens.plans import parameters as P
from pagelens.plans import sql as S
from pagelens.plans.enrichment import enriched
from pagelens.plans.entry import Registry, docs, pages
from pagelens.session import scratch_path, written
from pagelens.sources import content_store, dated, sinks
from pagelens.sources import tables as tb

ENTRIES = Registry()
AS_OF = datetime(2024, 3, 1, 12, 0, 0)


def content(spark: SparkSession, sf: str) -> DataFrame:
    return enriched(tb.table(spark, sf, "documents"), P.SENTIMENT)


def cube(spark: SparkSession, sf: str) -> DataFrame:
    return rp.job_cube(content(spark, sf))


def cancelled(spark: SparkSession, sf: str) -> DataFrame:
    toxic = tb.table(spark, sf, "labels").filter("toxic = 1")
    return (
        tb.table(spark, sf, "documents")
        .select("doc_id", F.concat(F.lit("job_"), "source").alias("job_id"))
        .join(toxic, "doc_id")
        .groupBy("job_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= P.CANCELLED_TOXIC)
    )


def job_rows(spark: SparkSession, sf: str) -> DataFrame:
    return tb.job_rows(docs(spark, sf))


def checked_rows(spark: SparkSession, sf: str) -> DataFrame:
    """`job_rows` as a table without texts, for queries that read them several times: every text is checked once."""
    return written(job_rows(spark, sf), "checked-rows")


def jobs(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    return rp.job_status(rp.job_counters(job_rows(spark, sf) if rows is None else rows), cancelled(spark, sf))


@ENTRIES.add("job_counters", "A1 A2", f"WITH {S.JOBS} SELECT * FROM counters")
def job_counters(spark, sf):
    return rp.job_counters(job_rows(spark, sf))


@ENTRIES.add("job_status", "R3", f"WITH {S.JOBS} SELECT job_id, status, processed_urls, failed_urls FROM jobs")
def job_status(spark, sf):
    return jobs(spark, sf).select("job_id", "status", "processed_urls", "failed_urls")


@ENTRIES.add(
    "job_error_rows",
    "A1",
    f"WITH {S.JOB_ROWS} SELECT job_id, content_id, reason || ': ' || url AS message FROM job_rows WHERE reason IS NOT NULL",
)
def job_error_rows(spark, sf):
    return rp.job_errors(job_rows(spark, sf))


@ENTRIES.add(
    "job_record_checks",
    "P6",
    f"""WITH {S.JOBS}, w AS (SELECT 'job_' || source AS job_id, count_if(lang <> 'en')::BIGINT AS missing FROM documents GROUP BY 1),
    j AS (SELECT left(job_id, CASE WHEN total_urls % 3 = 0 THEN 4 ELSE 99 END) AS job_id, job_id AS full_id,
        CASE WHEN failed_urls > 2 THEN 'started' ELSE status END AS status, total_urls - failed_urls AS total_urls,
        processed_urls - 48 AS processed_urls, failed_urls FROM jobs)
    SELECT full_id, concat_ws('; ', CASE WHEN length(j.job_id) < 5 THEN 'job_id has under 5 characters' END,
        CASE WHEN status NOT IN ('pending', 'running', 'completed', 'failed', 'cancelled') THEN 'unknown status ' || status END,
        CASE WHEN total_urls < 0 THEN 'total_urls is below zero' END,
        CASE WHEN processed_urls < 0 THEN 'processed_urls is below zero' END,
        CASE WHEN failed_urls < 0 THEN 'failed_urls is below zero' END) AS errors,
        concat_ws('; ', CASE WHEN processed_urls + failed_urls > total_urls THEN 'more addresses handled than given' END,
        CASE WHEN missing > 0 THEN missing || ' results without an address' END) AS warnings FROM j LEFT JOIN w ON w.job_id = j.full_id""",
)
def job_record_checks(spark, sf):
    # Job records bent out of shape by their own counters, so that every rule is met by some job.
    without_url = (
        tb.table(spark, sf, "documents")
        .groupBy(F.concat(F.lit("job_"), "source").alias("full_id"))
        .agg(F.count(F.when(F.col("lang") != "en", 1)).alias("missing"))
    )
    bent = jobs(spark, sf).select(
        F.col("job_id").alias("full_id"),
        F.when(F.col("total_urls") % 3 == 0, F.substring("job_id", 1, 4)).otherwise(F.col("job_id")).alias("job_id"),
        F.when(F.col("failed_urls") > 2, "started").otherwise(F.col("status")).alias("status"),
        (F.col("total_urls") - F.col("failed_urls")).alias("total_urls"),
        (F.col("processed_urls") - 48).alias("processed_urls"),
        "failed_urls",
    )
    return bent.join(without_url, "full_id", "left").select(
        "full_id",
        F.array_join(checks.job_errors(), "; ").alias("errors"),
        F.array_join(checks.job_warnings(F.coalesce("missing", F.lit(0))), "; ").alias("warnings"),
    )


FILTERS = {"min_word_count": 50, "max_word_count": "2000", "min_quality_score": 0.4, "has_errors": False, "colour": "x"}
MORE_FILTERS = {
    "category": "technology", "max_quality_score": "0.9", "engine_type": "static", "start_date": "2024-01-01T00:01:00Z",
    "end_date": "2024-06-30T00:00:00",
}


def filtered(spark: SparkSession, sf: str, filters: dict) -> DataFrame:
    """Enriched rows that pass an export filter, from the one store that all filters share."""
    path = content_store.register(content(spark, sf), [f"{sf}/documents.parquet"])
    return content_store.matching(spark, path, FilterSpec.parse(filters))


@ENTRIES.add(
    "export_filter",
    "P7 P8",
    f"""WITH {S.ENRICHED} SELECT content_id, job_id, word_count, quality_score FROM content
    WHERE word_count >= 50 AND word_count <= 2000 AND quality_score >= 0.4 AND error IS NULL""",
)
def export_filter(spark, sf):
    rows = filtered(spark, sf, FILTERS)
    return rows.select("content_id", "job_id", "word_count", "quality_score")


@ENTRIES.add(
    "extended_filter",
    "P8 P9",
    f"""WITH {S.ENRICHED} SELECT content_id, category, scraped_at FROM content WHERE category = 'technology' AND quality_score <= 0.9
        AND engine = 'static' AND scraped_at BETWEEN TIMESTAMP '2024-01-01 00:01:00' AND TIMESTAMP '2024-06-30'""",
)
def extended_filter(spark, sf):
    rows = filtered(spark, sf, MORE_FILTERS)
    return rows.select("content_id", "category", "scraped_at")


@ENTRIES.add(
    "date_range",
    "P9",
    """SELECT event_type, count(*) AS n, datediff('day', min(ts), max(ts)) AS days FROM events
    WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20' GROUP BY event_type""",
)
def date_range(spark, sf):
    rows = tb.table(spark, sf, "events").filter(
        checks.in_date_range(F.col("ts"), "2024-01-05T06:00:00Z", "2024-01-20")
    )
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.datediff(F.max("ts"), F.min("ts")).cast("bigint").alias("days")
    )


@ENTRIES.add("content_cube", "A3", f"WITH {S.ENRICHED}, {S.CUBE} SELECT job_id, category, sentiment, n, words, round(quality, 6) AS quality, first_id FROM cube")
def content_cube(spark, sf):
    return cube(spark, sf).withColumn("quality", F.round("quality", 6))


@ENTRIES.add(
    "job_statistics",
    "A3 S9",
    f"""WITH {S.ENRICHED} SELECT job_id, count(*) AS pages, sum(word_count)::BIGINT AS total_words,
        sum(word_count)::DOUBLE / count(*)::DOUBLE AS avg_words, (sum(word_count)::BIGINT // count(*)) AS avg_words_floor,
        round(sum(quality_score) / count(*), 6) AS avg_quality FROM content GROUP BY job_id""",
)
def job_statistics(spark, sf):
    return rp.job_statistics(cube(spark, sf))


@ENTRIES.add(
    "job_distributions",
    "A3 A5",
    f"""WITH {S.ENRICHED} SELECT job_id, 'category' AS kind, category AS value, count(*) AS n FROM content GROUP BY ALL
    UNION ALL SELECT job_id, 'sentiment', sentiment, count(*) FROM content GROUP BY ALL""",
)
def job_distributions(spark, sf):
    return rp.job_distributions(cube(spark, sf))


@ENTRIES.add(
    "report_overview",
    "A4 S14 W8",
    f"""WITH {S.ENRICHED}, c AS (SELECT job_id, category, count(*) AS n, min(content_id) AS f FROM content GROUP BY ALL)
    SELECT job_id, count(*) AS total_results, sum(word_count)::BIGINT AS total_words, {S.rounded('sum(word_count)::DOUBLE / count(*)', 1)} AS avg_words,
        any_value(best) AS most_common_category FROM content JOIN (SELECT job_id, arg_max(category, (n, -f)) AS best FROM c GROUP BY 1) USING (job_id)
    GROUP BY job_id""",
)
def report_overview(spark, sf):
    return rp.report_overview(cube(spark, sf))


@ENTRIES.add(
    "first_results",
    "S14 W4 W6",
    f"""WITH {S.ENRICHED}, r AS (SELECT job_id, content_id, url, word_count, {S.rounded('quality_score', 2)} AS quality,
        row_number() OVER (PARTITION BY job_id ORDER BY content_id) AS position FROM content) SELECT * FROM r WHERE position <= 10""",
)
def first_results(spark, sf):
    k = F.row_number().over(W.partitionBy("job_id").orderBy("content_id")).cast("bigint")
    rows = content(spark, sf).select(
        "job_id", "content_id", "url", "word_count", rounded(F.col("quality_score"), 2).alias("quality")
    )
    return rows.withColumn("position", k).filter(F.col("position") <= 10)


@ENTRIES.add(
    "first_errors",
    "S14 W4",
    f"""WITH {S.JOB_ROWS}, e AS (SELECT job_id, content_id, reason || ': ' || url AS message, row_number() OVER
        (PARTITION BY job_id ORDER BY content_id) AS position FROM job_rows WHERE reason IS NOT NULL) SELECT * FROM e WHERE position <= 5""",
)
def first_errors(spark, sf):
    k = F.row_number().over(W.partitionBy("job_id").orderBy("content_id")).cast("bigint")
    return rp.job_errors(job_rows(spark, sf)).withColumn("position", k).filter(F.col("position") <= 5)


for _column in ("category", "sentiment"):

    def _distribution(spark, sf, column=_column):
        return rp.distribution(content(spark, sf), column)

    ENTRIES.add(
        f"{_column}_distribution",
        "A5 W5",
        f"""WITH {S.ENRICHED} SELECT {_column} AS value, count(*) AS n, {S.rounded('count(*) * 100.0::DOUBLE / (SELECT count(*) FROM content)::DOUBLE', 1)} AS percent FROM content GROUP BY 1""",
    )(_distribution)


@ENTRIES.add(
    "quality_histogram",
    "A6",
    f"""WITH {S.ENRICHED}, b AS (SELECT min(quality_score) AS low, max(quality_score) AS high, round(avg(quality_score), 6) AS mean FROM content)
    SELECT least(floor((quality_score - low) / ((high - low) / 10.0::DOUBLE)) + 1, 10)::BIGINT AS bin, count(*) AS n, any_value(mean) AS mean
    FROM content, b GROUP BY 1""",
)
def quality_histogram(spark, sf):
    return rp.histogram(content(spark, sf).select("quality_score"), "quality_score")


@ENTRIES.add(
    "words_vs_quality",
    "A7 S11",
    f"""WITH {S.ENRICHED} SELECT url, title, word_count, category, sentiment, {S.rounded('quality_score', 3)} AS quality_score,
        CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, md5(content) AS content_md5 FROM content""",
)
def words_vs_quality(spark, sf):
    rows = sinks.display_rows(content(spark, sf))
    return rows.select(
        F.col("URL").alias("url"),
        F.col("Title").alias("title"),
        F.col("Word Count").alias("word_count"),
        F.col("Category").alias("category"),
        F.col("Sentiment").alias("sentiment"),
        rounded(F.col("Quality Score"), 3).alias("quality_score"),
        F.col("Status").alias("status"),
        F.md5("Full Content").alias("content_md5"),
    )


_LATEST = "latest AS (SELECT job_id FROM jobs ORDER BY start_time DESC, job_id LIMIT 1)"


@ENTRIES.add("latest_job", "W1", f"WITH {S.JOBS}, {_LATEST} SELECT job_id, start_time, status FROM jobs JOIN latest USING (job_id)")
def latest_job(spark, sf):
    return rp.latest_job(jobs(spark, sf)).select("job_id", "start_time", "status")


def _insight_shares(kind: str, section: int, limit: str) -> str:
    return f"""SELECT {section}::BIGINT, k, v || ': ' || n || ' pages, ' || {S.rounded('n * 100.0::DOUBLE / pages', 1)} || '%' FROM
        (SELECT {kind} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(content_id)) AS k FROM one GROUP BY 1), t {limit}"""


@ENTRIES.add(
    "latest_job_insight",
    "A8 W1 W2 W5",
    f"""WITH {S.ENRICHED}, {S.JOBS}, {_LATEST}, one AS (SELECT content.* FROM content JOIN latest USING (job_id)),
    t AS (SELECT count(*)::DOUBLE AS pages, sum(word_count)::BIGINT AS words, (sum(word_count)::BIGINT // count(*)) AS a,
        round(sum(quality_score) / count(*), 6) AS q FROM one),
    l AS (SELECT unnest(['pages: ' || pages::BIGINT, 'words: ' || words, 'average words: ' || a, 'quality level: ' ||
        CASE WHEN q >= 0.8 THEN 'Excellent' WHEN q >= 0.6 THEN 'Good' WHEN q >= 0.4 THEN 'Average' ELSE 'Needs Improvement' END,
        'quality is ' || CASE WHEN q > 0.6 THEN 'above average' WHEN q > 0.4 THEN 'average' ELSE 'below average' END,
        CASE WHEN a > 300 THEN 'word counts are good' ELSE 'longer content is advised' END,
        CASE WHEN q > 0.7 THEN 'keep current quality' ELSE 'work on quality' END,
        CASE WHEN a BETWEEN 300 AND 1000 THEN 'length is optimal' ELSE 'adjust content length' END]) AS line, unnest(range(1, 9)) AS ord FROM t)
    SELECT 1::BIGINT AS section, ord, line FROM l UNION ALL {_insight_shares('category', 2, 'WHERE k <= 3')}
    UNION ALL {_insight_shares('sentiment', 3, '')}""",
)
def latest_job_insight(spark, sf):
    latest = rp.latest_job(jobs(spark, sf)).select("job_id").scalar()
    return rp.job_insight(cube(spark, sf), latest)


@ENTRIES.add(
    "job_status_rollup",
    "A9",
    f"""WITH {S.JOBS} SELECT count(*) AS total_jobs, count_if(status IN ('running', 'started'))::BIGINT AS active_jobs,
        count_if(status = 'completed')::BIGINT AS completed_jobs, count_if(status = 'failed')::BIGINT AS failed_jobs,
        sum(processed_urls)::BIGINT AS total_urls_processed, (SELECT count(*) FROM job_rows WHERE reason IS NULL) AS total_content_analyzed FROM jobs""",
)
def job_status_rollup(spark, sf):
    stored = job_rows(spark, sf).filter("NOT failed").select(F.count(F.lit(1)).alias("n")).scalar()
    return rp.status_rollup(jobs(spark, sf), stored)


@ENTRIES.add(
    "job_progress",
    "A10 J1",
    f"""WITH {S.JOBS}, c AS (SELECT job_id, count(*) AS n FROM job_rows WHERE reason IS NULL GROUP BY 1)
    SELECT job_id, status, processed_urls || '/' || total_urls AS progress, total_urls - processed_urls AS urls_remaining,
        coalesce(n, 0) AS results_count FROM jobs LEFT JOIN c USING (job_id) WHERE status IN ('running', 'started', 'completed')""",
)
def job_progress(spark, sf):
    return rp.job_progress(jobs(spark, sf), job_rows(spark, sf).filter("NOT failed"))


@ENTRIES.add(
    "table_row_counts",
    "A11",
    f"""WITH {S.JOBS} SELECT 'scraping_jobs' AS table_name, count(*) AS n FROM jobs UNION ALL SELECT 'scraped_content', count(*) FROM documents
    UNION ALL SELECT 'content_categories', {len(seeds.DEFAULT_CATEGORIES)} UNION ALL SELECT 'system_metrics', count(*) FROM events""",
)
def table_row_counts(spark, sf):
    return rp.table_counts(
        {
            "scraping_jobs": jobs(spark, sf),
            "scraped_content": tb.table(spark, sf, "documents"),
            "content_categories": category_seed(spark),
            "system_metrics": tb.table(spark, sf, "events"),
        }
    )


def category_seed(spark: SparkSession) -> DataFrame:
    return seeds.table(spark, seeds.DEFAULT_CATEGORIES, "name string, description string, keywords array<string>")


_SEED_SQL = seeds.sql_values([(n, d, ",".join(w)) for n, d, w in seeds.DEFAULT_CATEGORIES], "name, description, keywords")


@ENTRIES.add(
    "category_rollup",
    "A13 J1",
    f"""WITH {S.ENRICHED}, c AS (SELECT category, count(*) AS n, sum(quality_score) AS q FROM content GROUP BY 1)
    SELECT name, coalesce(n, 0) AS content_count, round(q / n, 6) AS avg_quality_score FROM {_SEED_SQL} s LEFT JOIN c ON c.category = s.name""",
)
def category_rollup(spark, sf):
    return rp.category_rollup(cube(spark, sf), category_seed(spark))


@ENTRIES.add(
    "category_seed_upsert",
    "S5 J6",
    f"""WITH {S.ENRICHED} SELECT name, description, keywords FROM {_SEED_SQL} s WHERE name NOT IN (SELECT DISTINCT category FROM content)""",
)
def category_seed_upsert(spark, sf):
    existing = content(spark, sf).select(F.col("category").alias("name")).distinct()
    return tb.new_categories(category_seed(spark), existing).select(
        "name", "description", F.array_join("keywords", ",").alias("keywords")
    )


@ENTRIES.add(
    "session_rollup",
    "A14",
    """SELECT user_id::VARCHAR AS session_id, count(*) AS jobs_count, count_if(event_type = 'view')::BIGINT AS urls_scraped,
        max(ts) AS last_activity FROM events GROUP BY 1""",
)
def session_rollup(spark, sf):
    return rp.session_rollup(tb.table(spark, sf, "events"))


@ENTRIES.add(
    "metric_series",
    "A15",
    """SELECT event_type AS metric_name, date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS n, round(avg(value), 6) AS avg_value,
        max(value) AS max_value, sum((props::JSON->>'k')::BIGINT)::BIGINT AS context_sum FROM events GROUP BY 1, 2""",
)
def metric_series(spark, sf):
    return rp.metric_series(tb.table(spark, sf, "events"))


@ENTRIES.add(
    "source_comparison",
    "A16",
    f"""WITH {S.ENRICHED} SELECT job_id, count(*) AS documents, sum(word_count)::BIGINT AS words, round(avg(word_count), 6) AS avg_words,
        round(avg(quality_score), 6) AS avg_quality FROM content GROUP BY 1""",
)
def source_comparison(spark, sf):
    return rp.source_comparison(content(spark, sf))


@ENTRIES.add(
    "distinct_counts",
    "A17",
    """SELECT lang, count(DISTINCT source) AS sources, count(DISTINCT text) AS texts FROM documents GROUP BY lang""",
)
def distinct_counts(spark, sf):
    # Texts travel as fixed-size hashes; distinct pairs are formed before the count per language.
    rows = docs(spark, sf).select("lang", "source", F.sha2("text", 256).alias("h"))
    per = rows.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("texts"))
    sources = rows.select("lang", "source").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    return per.join(sources, "lang")


@ENTRIES.add(
    "result_page",
    "W7",
    f"""WITH {S.ENRICHED} SELECT content_id, url, word_count FROM content ORDER BY word_count DESC, content_id LIMIT 25 OFFSET 50""",
)
def result_page(spark, sf):
    rows = content(spark, sf).select("content_id", "url", "word_count")
    return rp.page_of(rows, [F.desc("word_count"), "content_id"], page=3, size=25)


@ENTRIES.add(
    "batch_progress",
    "W9 W6",
    f"""WITH {S.JOB_ROWS}, w AS (SELECT job_id, content_id, reason IS NOT NULL AS failed, row_number() OVER o AS position,
        sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER o AS processed_so_far,
        sum(CASE WHEN reason IS NOT NULL THEN 1 ELSE 0 END) OVER o AS failed_so_far FROM job_rows
        WINDOW o AS (PARTITION BY job_id ORDER BY content_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT job_id, content_id, failed, position, processed_so_far::BIGINT AS processed_so_far, failed_so_far::BIGINT AS failed_so_far,
        (position - 1) // 5 AS batch FROM w""",
)
def batch_progress(spark, sf):
    return rp.batches(job_rows(spark, sf))


@ENTRIES.add(
    "jobs_with_content",
    "J1",
    f"""WITH {S.JOBS} SELECT r.content_id, r.url, j.status, j.total_urls FROM job_rows r JOIN jobs j USING (job_id)""",
)
def jobs_with_content(spark, sf):
    j = jobs(spark, sf).select("job_id", "status", "total_urls")
    # One row per job: small against the content, but checked before it is broadcast.
    from pagelens.session import bounded_broadcast

    return job_rows(spark, sf).join(bounded_broadcast(j), "job_id").select("content_id", "url", "status", "total_urls")


@ENTRIES.add(
    "analysis_summary",
    "S16 P12",
    f"""WITH {S.ENRICHED} SELECT url, title, word_count, sentiment, category, quality_score, scraped_at AS analysis_timestamp FROM content""",
)
def analysis_summary(spark, sf):
    return sinks.analysis_summary(content(spark, sf))


@ENTRIES.add(
    "metric_rows",
    "S17",
    """WITH m AS (SELECT event_type AS category, count(*)::DOUBLE AS n, round(avg(value), 6) AS mean, max(value) AS highest FROM events GROUP BY 1)
    SELECT category, 'count' AS metric, n AS value FROM m UNION ALL SELECT category, 'mean', mean FROM m UNION ALL SELECT category, 'highest', highest FROM m""",
)
def metric_rows(spark, sf):
    nested = (
        tb.table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("category"))
        .agg(
            F.create_map(
                F.lit("count"), F.count(F.lit(1)).cast("double"),
                F.lit("mean"), F.round(F.avg("value"), 6),
                F.lit("highest"), F.max("value"),
            ).alias("metrics")
        )
    )
    return sinks.metric_rows(nested)


@ENTRIES.add(
    "parameterised_sql",
    "S21",
    """SELECT source, count(*) AS n, max(n_chars) AS longest FROM documents WHERE lang = 'fr' AND n_chars >= 500 GROUP BY source""",
)
def parameterised_sql(spark, sf):
    return tb.run_sql(
        spark,
        {"documents_view": tb.table(spark, sf, "documents")},
        "SELECT source, count(*) AS n, max(n_chars) AS longest FROM documents_view "
        "WHERE lang = :lang AND n_chars >= :size GROUP BY source",
        {"lang": "fr", "size": 500},
    )


# --- stored results and exports, read back -------------------------------------------------------


@ENTRIES.add(
    "store_results",
    "S4 S6",
    f"""WITH {S.ENRICHED}, {S.JOBS} SELECT c.content_id, c.job_id, c.word_count, c.sentiment, c.category, j.status, j.total_urls
    FROM content c JOIN jobs j USING (job_id)""",
)
def store_results(spark, sf):
    path = scratch_path(spark, "store")
    sinks.store_results(jobs(spark, sf), content(spark, sf), path)
    rows = spark.read.parquet(f"{path}/scraped_content")
    stored = spark.read.parquet(f"{path}/scraping_jobs").select("job_id", "status", "total_urls")
    return rows.join(stored, "job_id").select(
        "content_id",
        "job_id",
        "word_count",
        F.get_json_object("nlp_analysis", "$.sentiment").alias("sentiment"),
        F.get_json_object("classification", "$.category").alias("category"),
        "status",
        "total_urls",
    )


@ENTRIES.add(
    "json_export",
    "S7 S8 S18",
    f"""WITH {S.ENRICHED}, {S.JOBS}, e AS (SELECT job_id, count(*) AS n FROM job_rows WHERE reason IS NOT NULL GROUP BY 1)
    SELECT j.job_id, j.status, j.total_urls, j.duration, count(*) AS results, sum(c.word_count)::BIGINT AS words, coalesce(any_value(e.n), 0) AS errors,
        '1.0' AS version FROM jobs j JOIN content c USING (job_id) LEFT JOIN e USING (job_id) GROUP BY ALL""",
)
def json_export(spark, sf):
    path = sinks.export_folder(scratch_path(spark, "json"), AS_OF)
    sinks.export_jobs(
        jobs(spark, sf), content(spark, sf).select("job_id", "content_id", "url", "word_count", "quality_score"),
        rp.job_errors(job_rows(spark, sf)), path, AS_OF,
    )
    head = spark.read.schema(
        "job_id string, status string, total_urls bigint, duration bigint"
    ).json(f"{path}/job_summary")
    rows = spark.read.schema("job_id string, word_count bigint").json(f"{path}/scraping-results")
    errors = spark.read.schema("job_id string, message string").json(f"{path}/errors")
    meta = spark.read.schema("version string").json(f"{path}/export_metadata")
    n_errors = errors.groupBy("job_id").agg(F.count(F.lit(1)).alias("errors"))
    totals = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("results"), F.sum("word_count").alias("words"))
    return (
        head.join(totals, "job_id")
        .join(n_errors, "job_id", "left")
        .withColumn("errors", F.coalesce("errors", F.lit(0)))
        .withColumn("version", meta.scalar())
    )


@ENTRIES.add(
    "csv_export",
    "S10 P11 P12",
    f"""WITH {S.ENRICHED} SELECT url, title, word_count, left(content, 200) || '...' AS content_preview, sentiment, category,
        round(quality_score, 6) AS quality_score, round(readability_score, 6) AS readability_score FROM content""",
)
def csv_export(spark, sf):
    path = scratch_path(spark, "csv")
    nested = content(spark, sf).withColumns(
        {
            "analysis": F.struct(
                F.struct(F.col("sentiment").alias("label"), F.col("compound").alias("score")).alias("sentiment"),
                F.lit(None).cast("string").alias("language"),
                F.col("readability_score").alias("readability"),
                F.col("category").alias("category"),
            ),
            "classification": F.struct(
                F.col("category").alias("predicted_category"), F.col("category_confidence").alias("confidence")
            ),
        }
    )
    sinks.write_csv(sinks.flat_rows(nested), path)
    back = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .schema(
            "url string, title string, word_count bigint, scraping_engine string, scraped_at string, content_preview string, "
            "sentiment string, sentiment_score double, language string, readability_score double, category string, "
            "predicted_category string, classification_confidence double, quality_score double"
        )
        .csv(path)
    )
    return back.select(
        "url", F.coalesce("title", F.lit("")).alias("title"), "word_count", "content_preview", "sentiment", "category",
        F.round("quality_score", 6).alias("quality_score"), F.round("readability_score", 6).alias("readability_score"),
    )


@ENTRIES.add(
    "text_report",
    "S12 W5 W6",
    f"""WITH {S.ENRICHED}, {S.JOBS}, b AS (SELECT job_id, count(*) AS pages, sum(word_count)::BIGINT AS words, sum(quality_score) AS q FROM content GROUP BY 1),
    s AS (SELECT * FROM jobs JOIN b USING (job_id)), h AS (SELECT job_id, unnest(['CONTENT ANALYSIS REPORT', 'Job ID: ' || job_id, 'Status: ' || status,
        'Total URLs: ' || total_urls, 'Processed: ' || processed_urls, 'Duration in seconds: ' || duration]) AS line, unnest(range(0, 6)) AS part FROM s),
    u AS (SELECT job_id, unnest(['Total Word Count: ' || words, 'Average Words per Page: ' || (words // pages), 'Average Quality Score: ' || {S.rounded('q / pages', 2)}]) AS line,
        unnest(range(0, 3)) AS part FROM s),
    c AS (SELECT job_id, category, count(*) AS k, row_number() OVER (PARTITION BY job_id ORDER BY count(*) DESC, min(content_id)) AS n FROM content GROUP BY job_id, category),
    r AS (SELECT job_id, content_id AS n, unnest([title, '   URL: ' || url, '   Words: ' || word_count, '   Category: ' || category,
        '   Sentiment: ' || sentiment, '   Quality: ' || {S.rounded('quality_score', 2)}, '   Full Content: ' || content]) AS line, unnest(range(0, 7)) AS part FROM content)
    SELECT job_id, 1::BIGINT AS section, 0::BIGINT AS n, part, line FROM h UNION ALL SELECT job_id, 2, 0, part, line FROM u
    UNION ALL SELECT c.job_id, 3, n, 0, category || ': ' || k || ' pages, ' || {S.rounded('k * 100.0::DOUBLE / pages', 1)} || '%' FROM c JOIN b USING (job_id)
    UNION ALL SELECT job_id, 4, n, part, line FROM r""",
)
def text_report(spark, sf):
    c = written(content(spark, sf), "report-rows")
    return sinks.report_lines(jobs(spark, sf), rp.job_cube(c), c)


@ENTRIES.add(
    "sheet_tables",
    "S13 S14",
    f"""WITH {S.ENRICHED}, {S.JOBS} SELECT 'job_summary' AS sheet, count(*) AS n, min(job_id) AS first_key FROM jobs
    UNION ALL SELECT 'results', count(*), min(url) FROM content
    UNION ALL SELECT 'detailed_analysis', count(*), min(left(content, 500)) FROM content
    UNION ALL SELECT 'errors', count(*), min(reason || ': ' || url) FROM job_rows WHERE reason IS NOT NULL""",
)
def sheet_tables(spark, sf):
    c, rows = content(spark, sf), checked_rows(spark, sf)
    sheets = sinks.sheet_tables(
        jobs(spark, sf, rows), c, c.select("job_id", "url", F.col("content").alias("response")), rp.job_errors(rows)
    )
    keys = {"job_summary": "job_id", "results": "url", "detailed_analysis": "summary", "errors": "message"}
    path = scratch_path(spark, "sheets")
    out = None
    for name, df in sheets.items():
        df.write.parquet(f"{path}/{name}")
        part = spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("n"), F.min(keys[name]).alias("first_key"))
        part = part.select(F.lit(name).alias("sheet"), "n", "first_key")
        out = part if out is None else out.union(part)
    return out


@ENTRIES.add(
    "sheet_rows",
    "S13",
    f"""WITH {S.ENRICHED}, {S.JOBS} SELECT 'job_summary' AS sheet, job_id, NULL AS key, total_urls AS n, md5(status || ' ' || processed_urls || ' ' || failed_urls) AS digest FROM jobs
    UNION ALL SELECT 'results', job_id, url, word_count, md5(title || ' ' || category || ' ' || sentiment) FROM content
    UNION ALL SELECT 'detailed_analysis', job_id, url, length(left(content, 500)), md5(content) FROM content
    UNION ALL SELECT 'errors', job_id, NULL, content_id, md5(reason || ': ' || url) FROM job_rows WHERE reason IS NOT NULL""",
)
def sheet_rows(spark, sf):
    path, c, day = scratch_path(spark, "workbook"), content(spark, sf), F.lit(AS_OF).cast("timestamp_ntz")
    rows = checked_rows(spark, sf)
    sheets = sinks.sheet_tables(
        jobs(spark, sf, rows), c, c.select("job_id", "url", F.col("content").alias("response")), rp.job_errors(rows)
    )
    shown = {
        "job_summary": (F.lit(None).cast("string"), F.col("total_urls"), F.concat_ws(" ", "status", "processed_urls", "failed_urls")),
        "results": (F.col("url"), F.col("word_count"), F.concat_ws(" ", "title", "category", "sentiment")),
        "detailed_analysis": (F.col("url"), F.length("summary").cast("bigint"), F.col("response")),
        "errors": (F.lit(None).cast("string"), F.col("content_id"), F.col("message")),
    }
    out = None
    for name, df in sheets.items():
        # Each sheet goes to dated folders of its jobs and comes back by value.
        rows = df.withColumn("at", day)
        dated.export_dated(rows, "at", "job_id", f"{path}/{name}", "parquet", name, AS_OF, [x for x in df.columns if x != "job_id"])
        back = dated.read_dated(spark, f"{path}/{name}", df.drop("job_id").schema, "parquet")
        key, n, text = shown[name]
        part = back.select(F.lit(name).alias("sheet"), "job_id", key.alias("key"), n.alias("n"), F.md5(text).alias("digest"))
        out = part if out is None else out.union(part)
    return out


@ENTRIES.add(
    "statistics_export",
    "S9",
    f"""WITH {S.ENRICHED}, t AS (SELECT job_id, sum(word_count)::BIGINT AS total_words, round(sum(word_count)::DOUBLE / count(*), 6) AS average_words,
        round(sum(quality_score) / count(*), 6) AS average_quality FROM content GROUP BY 1),
    v AS (SELECT job_id, 'category' AS kind, category AS value, count(*) AS n FROM content GROUP BY ALL
        UNION ALL SELECT job_id, 'sentiment', sentiment, count(*) FROM content GROUP BY ALL),
    r AS (SELECT job_id, count(*) AS rows_read, sum(content_id)::BIGINT AS ids, sum(length(url))::BIGINT AS url_chars FROM content GROUP BY 1)
    SELECT * FROM v JOIN t USING (job_id) JOIN r USING (job_id)""",
)
def statistics_export(spark, sf):
    path = scratch_path(spark, "statistics-export")
    sinks.export_statistics(content(spark, sf).drop("content"), path)
    back = sinks.read_statistics(spark, path)
    read = back["scraped_results"].groupBy("job_id").agg(
        F.count(F.lit(1)).alias("rows_read"), F.sum("content_id").alias("ids"), F.sum(F.length("url")).alias("url_chars")
    )
    totals = back["statistics"].select("job_id", "total_words", F.round("average_words", 6).alias("average_words"), F.round("average_quality", 6).alias("average_quality"))
    return back["distributions"].join(totals, "job_id").join(read, "job_id")


@ENTRIES.add(
    "display_export",
    "S11",
    f"""WITH {S.ENRICHED} SELECT url, title, word_count, category, sentiment, {S.rounded('quality_score', 3)} AS quality_score,
        CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, md5(content) AS content_md5 FROM content""",
)
def display_export(spark, sf):
    path = scratch_path(spark, "display")
    sinks.write_csv(sinks.display_rows(content(spark, sf)), path)
    back = sinks.read_csv(spark, path, sinks.DISPLAY)
    return back.select(
        F.col("URL").alias("url"), F.col("Title").alias("title"), F.col("Word Count").alias("word_count"), F.col("Category").alias("category"),
        F.col("Sentiment").alias("sentiment"), rounded(F.col("Quality Score"), 3).alias("quality_score"), F.col("Status").alias("status"),
        F.md5("Full Content").alias("content_md5"),
    )


@ENTRIES.add(
    "export_log",
    "S15 S19 J2",
    f"""WITH {S.JOBS}, {_LATEST} SELECT 'exp-1' AS export_id, job_id, 'json' AS export_type, (SELECT count(*) FROM documents) AS record_count,
        'completed' AS status, status AS job_status FROM jobs JOIN latest USING (job_id)
    UNION ALL SELECT 'exp-2', NULL, 'csv', (SELECT count(*) FROM events), 'completed', NULL
    UNION ALL SELECT 'exp-3', NULL, 'docx', 0, 'failed', NULL""",
)
def export_log(spark, sf):
    path = scratch_path(spark, "exports")
    j = jobs(spark, sf)
    last = rp.latest_job(j).first()["job_id"]
    d = tb.table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    log = (
        sinks.export_table(d, "json", f"{path}/1", "exp-1", AS_OF, {"kind": "documents"}, job_id=last)
        .union(sinks.export_table(tb.table(spark, sf, "events"), "csv", f"{path}/2", "exp-2", AS_OF))
        .union(sinks.export_table(d, "docx", f"{path}/3", "exp-3", AS_OF))
    )
    states = j.select("job_id", F.col("status").alias("job_status"))
    # The job of an export may be missing, so the log keeps every row.
    return log.join(states, "job_id", "left").select(
        "export_id", "job_id", "export_type", "record_count", "status", "job_status"
    )


_HALVES = (("first", "2024-01-01", "2024-01-16"), ("second", "2024-01-16", "2024-02-01"))


def dated_events(spark: SparkSession, sf: str) -> str:
    """Two exports of events as lines, each half a month, into a folder for each day and event type; then the second once more."""
    path = scratch_path(spark, "dated")
    line = F.concat_ws(",", F.col("event_id").cast("string"), "event_type")
    e = tb.table(spark, sf, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", line.alias("value"))
    for name, start, end in (*_HALVES, _HALVES[1]):
        half = e.filter((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
        dated.export_dated(half, "ts", "event_type", path, "text", name, datetime.fromisoformat(end), ["value"])
    return path


_LINE_BYTES = "octet_length(encode(event_id || ',' || event_type)) + 1"


@ENTRIES.add(
    "dated_exports",
    "S18 S7",
    f"""SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, event_type AS job_id, count(*) AS record_count,
        sum({_LINE_BYTES})::BIGINT AS bytes, count(*) AS rows_read, sum(event_id)::BIGINT AS ids FROM events GROUP BY ALL""",
)
def dated_exports(spark, sf):
    path = dated_events(spark, sf)
    back = dated.read_dated(spark, path, StructType().add("value", "string"), "text").groupBy(*dated.FOLDER).agg(
        F.count(F.lit(1)).alias("rows_read"), F.sum(F.substring_index("value", ",", 1).cast("bigint")).alias("ids")
    )
    return dated.read_manifest(spark, path).select(*dated.FOLDER, "record_count", "bytes").join(back, dated.FOLDER)


@ENTRIES.add(
    "storage_statistics",
    "S20 A12 S18",
    f"""SELECT '.txt' AS extension, count(DISTINCT (ts::DATE, event_type)) AS files, sum({_LINE_BYTES})::BIGINT AS bytes,
        round(sum({_LINE_BYTES}) / (1024 * 1024), 2) AS megabytes FROM events""",
)
def storage_statistics(spark, sf):
    return rt.file_statistics(dated.as_files(dated.read_manifest(spark, dated_events(spark, sf))))


@ENTRIES.add(
    "expired_exports",
    "D2 S20",
    f"""SELECT ts < TIMESTAMP '2024-01-16' AS expired, count(DISTINCT (ts::DATE, event_type)) AS files, sum({_LINE_BYTES})::BIGINT AS bytes
    FROM events GROUP BY 1""",
)
def expired_exports(spark, sf):
    files = dated.as_files(dated.read_manifest(spark, dated_events(spark, sf)))
    gone = rt.expired_files(files, F.lit("2024-02-02 00:00:00").cast("timestamp_ntz")).select("key", F.lit(True).alias("expired"))
    marked = files.join(gone, "key", "left").withColumn("expired", F.coalesce("expired", F.lit(False)))
    return marked.groupBy("expired").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


_EXPIRED = """ends AS (SELECT max(end_time) AS last_end FROM jobs), expired AS (SELECT job_id FROM jobs, ends
    WHERE status = 'completed' AND end_time < last_end - INTERVAL 5 SECOND)"""


@ENTRIES.add(
    "retention",
    "D1 J7",
    f"""WITH {S.JOBS}, {_EXPIRED} SELECT job_id, count(*) AS content_rows, (SELECT count(*) FROM expired) AS removed_jobs FROM job_rows
    WHERE job_id NOT IN (SELECT job_id FROM expired) GROUP BY job_id""",
)
def retention(spark, sf):
    j = jobs(spark, sf)
    # Jobs end within one day here, so the age limit is set to five seconds before the last end.
    as_of = j.select((F.max("end_time") + F.make_dt_interval(F.lit(30), F.lit(0), F.lit(0), F.lit(-5))).alias("t")).scalar()
    gone = rt.expired_jobs(j, as_of, days=30)
    kept = rt.without_expired(job_rows(spark, sf), gone)
    removed = gone.select(F.count(F.lit(1)).alias("n")).scalar()
    return kept.groupBy("job_id").agg(F.count(F.lit(1)).alias("content_rows")).withColumn("removed_jobs", removed)
