"""The content store: one write for all filters, row groups skipped on read, and exports that come back by value."""

import datetime as dt

from pyspark.sql import functions as F

from pagelens.operators.filters import FilterSpec
from pagelens.sources import content_store, sinks

NAMES = ["business", "health", "science", "technology"]


def rows(spark, n=40_000):
    i = F.col("id")
    return spark.range(n).select(
        i.alias("content_id"), F.concat(F.lit("job_"), (i % 7).cast("string")).alias("job_id"), F.concat(F.lit("https://h/"), i.cast("string")).alias("url"),
        F.sha2(i.cast("string"), 512).alias("content"), F.element_at(F.array(*[F.lit(x) for x in NAMES]), (F.xxhash64("id") % 4 % 2 + 2).cast("int")).alias("category"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.xxhash64("id") % 50 + 50).cast("int"))).alias("scraped_at"),
        (i % 100).alias("word_count"), F.lit(0.5).alias("quality_score"), F.lit("static").alias("engine"), F.lit(None).cast("string").alias("error"),
    )


def rows_scanned(df):
    """Rows that left the scan, after row groups were skipped and before the filter; runs the plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_filters_skip_row_groups_and_find_the_same_rows(spark, tmp_path):
    content, path = rows(spark), str(tmp_path / "store")
    content_store.write(content, path, row_group_bytes=100_000)
    total = content.count()
    for filters in (
        {"category": "business"}, {"start_date": "2024-01-03", "end_date": "2024-01-06T00:00:00Z"}, {"category": "science", "start_date": "2024-03-20"},
        {"category": "nothing"}, {"min_word_count": 98, "has_errors": False}, {},
    ):
        spec = FilterSpec.parse(filters)
        found = content_store.matching(spark, path, spec)
        assert found.columns == content.columns
        want = content.filter(spec.column())
        assert found.exceptAll(want).count() == 0 and want.exceptAll(found).count() == 0
        if "category" in filters:
            assert rows_scanned(found) < 0.8 * total
        elif "start_date" in filters:
            assert rows_scanned(found) < 0.8 * total
    one = spark.read.parquet(path).filter("url = 'https://h/77'")
    assert one.count() == 1 and rows_scanned(one) < total / 2


def test_two_filters_share_one_write_and_a_changed_input_makes_a_new_one(spark, tmp_path):
    source = str(tmp_path / "in.parquet")
    rows(spark, 100).write.parquet(source)
    read = lambda: spark.read.parquet(source).withColumn("more", F.col("word_count") + 1)
    first = content_store.register(read(), [source])
    assert content_store.register(read(), [source]) == first
    # Other rows of the same input, and more input, are other stores.
    assert content_store.register(read().filter("content_id < 5"), [source]) != first
    rows(spark, 3).write.mode("append").parquet(source)
    second = content_store.register(read(), [source])
    assert second != first and spark.read.parquet(second).count() == 103 and spark.read.parquet(first).count() == 100


def test_empty_content_makes_an_empty_store(spark, tmp_path):
    content_store.write(rows(spark, 5).filter("content_id < 0"), str(tmp_path / "e"))
    assert content_store.matching(spark, str(tmp_path / "e"), FilterSpec.parse({"category": "health"})).count() == 0


def test_csv_keeps_outer_blanks_quotes_and_line_ends(spark, tmp_path):
    texts = ["  led and trailed\t", 'say "x", then\nstop', "back\\slash\\", "\r\nwindows\r\n", "é☃", "a "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i bigint, t string")
    sinks.write_csv(df, str(tmp_path / "c"))
    back = sinks.read_csv(spark, str(tmp_path / "c"), "i bigint, t string").orderBy("i")
    assert [r["t"] for r in back.collect()] == texts


def test_statistics_fit_the_written_results(spark, tmp_path):
    data = [(1, "j1", "u1", 10, "a", "positive", 0.5), (2, "j1", "u2", 20, "b", None, 1.0), (3, "j/2", "u3", None, "a", "negative", None)]
    df = spark.createDataFrame(data, "content_id bigint, job_id string, url string, word_count bigint, category string, sentiment string, quality_score double")
    sinks.export_statistics(df, str(tmp_path / "s"))
    back = sinks.read_statistics(spark, str(tmp_path / "s"))
    assert sorted(r["content_id"] for r in back["scraped_results"].collect()) == [1, 2, 3]
    stats = {r["job_id"]: (r["total_words"], r["average_words"], r["average_quality"]) for r in back["statistics"].collect()}
    assert stats == {"j1": (30, 15.0, 0.75), "j/2": (None, None, None)}
    shares = {(r["job_id"], r["kind"], r["value"]): r["n"] for r in back["distributions"].collect()}
    assert shares[("j1", "category", "a")] == 1 and shares[("j/2", "category", "a")] == 1 and sum(shares.values()) == 6
