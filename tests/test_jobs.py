"""Jobs, exports, retention and streams on hand-made rows."""

import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from pagelens.functions.responses_input import search
from pagelens.operators import reports as rp
from pagelens.operators import retention as rt
from pagelens.sources import sinks
from pagelens.sources import tables as tb
from pagelens.streaming import ingest

AS_OF = datetime(2024, 3, 1, 12, 0, 0)


def test_status_rules(spark):
    jobs = spark.createDataFrame(
        [("j0", 0, 0, 0), ("j1", 3, 0, 3), ("j2", 3, 2, 1), ("j3", 3, 1, 0), ("j4", 3, 0, 0), ("j5", 1, 1, 0)],
        "job_id string, total_urls bigint, processed_urls bigint, failed_urls bigint",
    )
    cancelled = spark.createDataFrame([("j5",)], "job_id string")
    got = {r["job_id"]: r["status"] for r in rp.job_status(jobs, cancelled).collect()}
    assert got == {"j0": "failed", "j1": "failed", "j2": "completed", "j3": "running", "j4": "pending", "j5": "cancelled"}


def test_overview_first_seen_wins(spark):
    content = spark.createDataFrame(
        [(1, "j", "b", "x", 10, 0.5), (2, "j", "a", "x", 20, 0.5), (3, "j", None, "y", 31, 0.5)],
        "content_id bigint, job_id string, category string, sentiment string, word_count bigint, quality_score double",
    )
    row = rp.report_overview(rp.job_cube(content)).first()
    assert row["most_common_category"] == "b" and row["total_words"] == 61 and row["avg_words"] == 20.3
    stats = rp.job_statistics(rp.job_cube(content)).first()
    assert stats["avg_words_floor"] == 20 and stats["avg_words"] == 61 / 3


def test_distribution_and_histogram(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(11)], "v double")
    assert sum(r["n"] for r in rp.histogram(df, "v").collect()) == 11
    one = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [(r["bin"], r["n"], r["mean"]) for r in rp.histogram(one, "v").collect()] == [(1, 2, 2.0)]
    shares = rp.distribution(spark.createDataFrame([("a",), ("a",), ("b",)], "k string"), "k").collect()
    assert [(r["value"], r["n"], r["percent"]) for r in shares] == [("a", 2, 66.7), ("b", 1, 33.3)]


def test_paging(spark):
    df = spark.range(30)
    assert [r["id"] for r in rp.page_of(df, ["id"], 2, 5).collect()] == [5, 6, 7, 8, 9]
    assert rp.page_of(df, ["id"], 0, 0).count() == 10
    assert rp.page_of(df, ["id"], 1, 9999, max_size=7).count() == 7
    assert rp.paging(3, 7, 7) == (3, 7, None) and rp.paging("x", None) == (1, 10, None)
    assert rp.paging(2, 9999, 7) == (2, 7, "a page holds at most 7 rows, not 9999")


def test_retention_removes_jobs_and_content(spark):
    jobs = spark.createDataFrame(
        [("old", "completed", datetime(2024, 1, 1)), ("new", "completed", datetime(2024, 2, 20)), ("oldrun", "running", datetime(2024, 1, 1))],
        "job_id string, status string, end_time timestamp_ntz",
    )
    gone = rt.expired_jobs(jobs, F.lit("2024-03-01 12:00:00").cast("timestamp_ntz"))
    assert [r["job_id"] for r in gone.collect()] == ["old"]
    content = spark.createDataFrame([("old",), ("new",), ("oldrun",)], "job_id string")
    assert sorted(r["job_id"] for r in rt.without_expired(content, gone).collect()) == ["new", "oldrun"]


def test_empty_csv_has_one_stated_row(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([], "a string"), str(tmp_path / "e"))
    text = "".join(p.read_text() for p in (tmp_path / "e").glob("*.csv"))
    assert sinks.NO_DATA in text


def test_export_table_logs_success_and_failure(spark, tmp_path):
    df = spark.range(7)
    row = sinks.export_table(df, "json", str(tmp_path / "x"), "e1", AS_OF, {"k": "v"}, "job_1").first()
    assert (row["status"], row["record_count"], row["export_id"]) == ("completed", 7, "e1") and row["file_size"] > 0
    manifest = json.loads("".join(p.read_text() for p in (tmp_path / "x" / "manifest").glob("*.json")))
    assert manifest["record_count"] == 7 and manifest["metadata"] == {"k": "v"}
    bad = sinks.export_table(df, "pdf", str(tmp_path / "y"), "e2", AS_OF).first()
    assert bad["status"] == "failed" and "Unsupported format" in bad["error"]


def test_export_paths(spark):
    assert sinks.export_folder("s3a://b/", AS_OF, "job_1") == "s3a://b/exports/2024/03/01/job_1"
    name = spark.range(1).select(sinks.export_name(F.lit("job/1"), AS_OF, "csv")).first()[0]
    assert name == "job_1_20240301_120000.csv"
    dated = sinks.with_export_path(spark.range(1), AS_OF).first()
    assert (dated["year"], dated["month"], dated["day"]) == ("2024", "03", "01")


def test_report_is_written_in_order(spark, tmp_path):
    lines = spark.createDataFrame(
        [("j", 4, 2, 0, "d"), ("j", 1, 0, 1, "b"), ("j", 1, 0, 0, "a"), ("j", 4, 1, 0, "c")],
        "job_id string, section bigint, n bigint, part bigint, line string",
    )
    sinks.write_report(lines, str(tmp_path / "r"))
    files = sorted(Path(tmp_path / "r" / "job_id=j").glob("part*"))
    assert "".join(f.read_text() for f in files).split() == ["a", "b", "c", "d"]


def test_search_equals_brute_force(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox"), (2, "quick foxes"), (3, "a Brown dog")], "id bigint, text string")
    queries = spark.createDataFrame([(1, "quick brown fox"), (2, "QUICK"), (3, "own"), (4, "e quick b"), (5, "  ")], "q bigint, s string")
    got = {(r["q"], r["id"]) for r in search(docs, "id", "text", queries, "q", "s").collect()}
    want = {
        (q, i)
        for q, s in ((1, "quick brown fox"), (2, "quick"), (3, "own"), (4, "e quick b"))
        for i, t in ((1, "the quick brown fox"), (2, "quick foxes"), (3, "a brown dog"))
        if s in t
    }
    assert {x for x in got if x[0] != 5} == want


def test_stream_equals_batch_with_replays_and_small_triggers(spark, small, tmp_path):
    pages = tb.table(spark, small, "pages")
    parts = pages.randomSplit([1.0, 1.0, 1.0], seed=4)
    for i, part in enumerate([*parts, parts[0]]):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "landed"))
    stream = ingest.landed(spark, str(tmp_path / "landed"), "pages", files_per_batch=1)
    once = ingest.once_per_key(stream, "page_id")
    ingest.ingest_pages(once, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = ingest.page_rows(pages)
    assert got.count() == want.count()
    assert got.exceptAll(want.select(got.columns)).isEmpty()
    # A second run over the same folder has nothing left to do.
    again = ingest.once_per_key(ingest.landed(spark, str(tmp_path / "landed"), "pages"), "page_id")
    ingest.ingest_pages(again, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want.count()


def test_progress_callback_sees_running_totals(spark, small, tmp_path):
    docs = tb.table(spark, small, "documents")
    for part in docs.randomSplit([1.0, 1.0], seed=1):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    seen = []
    rows = tb.job_rows(ingest.landed(spark, str(tmp_path / "docs"), "documents", files_per_batch=1))
    ingest.publish_progress(
        rows, lambda df, i: seen.append(df.agg(F.sum(F.col("processed_urls") + F.col("failed_urls"))).first()[0]), str(tmp_path / "cp")
    ).awaitTermination()
    assert len(seen) == 2 and max(seen) == docs.count()
