"""Validity rules, filters and names with hand-made rows."""

import pytest
from pyspark.sql import functions as F

from pagelens.functions import checks
from pagelens.operators.filters import FilterSpec


@pytest.mark.parametrize(
    "url,reason",
    [
        ("https://example.org/a", None),
        ("  http://example.org  ", None),
        ("http://a.b", "malformed"),
        ("http://a", "too short"),
        ("", "empty"),
        (None, "empty"),
        ("example.org/page", "malformed"),
        ("ftp://example.org/", "scheme"),
        ("http://localhost:80/x", "refused pattern"),
        ("http://127.0.0.1/x", "refused pattern"),
        ("http://192.168.1.4/x", "refused pattern"),
        ("http://172.20.0.1/x", "refused pattern"),
        ("http://172.32.0.1/x", None),
        ("http://example.org/v10.2", "refused pattern"),
        ("http://example.org/a b", "malformed"),
    ],
)
def test_url(one, url, reason):
    assert one(lambda f: checks.url_rejection(f.col("x")), url) == reason


def test_strict_host_keeps_paths(one):
    assert one(lambda f: checks.url_rejection(f.col("x"), strict_host=True), "http://example.org/v10.2") is None
    assert one(lambda f: checks.url_rejection(f.col("x"), strict_host=True), "http://10.1.2.3/abc") == "refused pattern"


@pytest.mark.parametrize(
    "text,reason",
    [
        (None, "empty"),
        ("   ", "too short"),
        ("a b c d e", "too short"),
        ("a b c d ef", None),
        ("a b " + "x" * 9996, None),
        ("a b " + "x" * 9997, "too long"),
        ("twowords only", "too few words"),
        ("a b c !!!", "too short"),
        ("a b cd!!!!", None),
        ("a b c!!!!!!", "special characters"),
        ("one two <script>\nx</script>", "refused pattern"),
        ("see DATA:IMAGE/png now", "refused pattern"),
    ],
)
def test_content(one, text, reason):
    assert one(lambda f: checks.content_rejection(f.col("x")), text) == reason


def test_previews(one):
    assert one(lambda f: checks.preview(f.col("x"), 3, True), "ab") == "ab..."
    assert one(lambda f: checks.preview(f.col("x"), 3, True), "") == ""
    assert one(lambda f: checks.preview(f.col("x"), 3, False), "abc") == "abc"
    assert one(lambda f: checks.preview(f.col("x"), 3, False), "abcd") == "abc..."


@pytest.mark.parametrize(
    "name,clean",
    [
        ('a<b>:"/\\|?*.txt', "a_b________.txt"),
        (" .hidden. ", "hidden"),
        ("...", "untitled"),
        (None, "untitled"),
        ("x" * 300 + ".json", "x" * 250 + ".json"),
        ("y" * 300, "y" * 255),
    ],
)
def test_names(one, name, clean):
    assert one(lambda f: checks.clean_name(f.col("x")), name) == clean


def test_query_cleaning(one):
    assert one(lambda f: checks.clean_query(f.col("x")), "  a<b>\x07c  ") == "abc"
    assert one(lambda f: checks.clean_query(f.col("x")), "   ") is None
    # Inputs stay whole; callers are told which are longer than the reported limit.
    assert one(lambda f: checks.clean_query(f.col("x")), "q" * 2000) == "q" * 2000
    assert one(lambda f: checks.long_query(f.col("x")), "q" * 2000) and not one(lambda f: checks.long_query(f.col("x")), " " + "q" * 1000)


def test_job_checks(spark):
    rows = [
        ("job_1", "completed", 5, 3, 2),
        ("j", "stopped", -1, 0, 0),
        (None, None, None, None, None),
        ("job_2", "running", 2, 2, 1),
    ]
    df = spark.createDataFrame(
        rows, "job_id string, status string, total_urls bigint, processed_urls bigint, failed_urls bigint"
    )
    got = df.select(checks.job_errors().alias("e"), checks.job_warnings(F.lit(0)).alias("w")).collect()
    assert got[0]["e"] == [] and got[0]["w"] == []
    assert got[1]["e"] == [
        "job_id has under 5 characters", "unknown status stopped", "total_urls is below zero",
    ]
    assert got[2]["e"] == [
        "job_id is not given", "status is not given", "total_urls is not given",
    ]
    assert got[3]["w"] == ["more addresses handled than given"]


def test_filter_spec():
    spec = FilterSpec.parse({"min_word_count": "5", "status": " ", "colour": 1, "max_quality_score": 2, "max_word_count": -1 + 9})
    assert spec.values == {"min_word_count": 5, "max_quality_score": 2.0, "max_word_count": 8}
    assert spec.warnings == [
        "status is empty", "colour is no known filter", "max_quality_score lies outside 0 to 1",
    ]
    with pytest.raises(ValueError, match="no value lies between min_word_count"):
        FilterSpec.parse({"min_word_count": 9, "max_word_count": 1})
    with pytest.raises(ValueError, match="does not read as int"):
        FilterSpec.parse({"min_word_count": "many"})
    with pytest.raises(ValueError, match="ends before it starts"):
        FilterSpec.parse({"start_date": "2024-02-01", "end_date": "2024-01-01"})
    assert FilterSpec.parse({"start_date": "2022-01-01", "end_date": "2024-01-01"}).warnings


def test_filter_defaults_for_missing_values(spark):
    df = spark.createDataFrame(
        [(1, None, None, None, None), (2, 10, 0.9, "a", "bad")],
        "id int, word_count bigint, quality_score double, category string, error string",
    )

    def ids(**filters):
        return [r["id"] for r in df.filter(FilterSpec.parse(filters).column()).collect()]

    assert ids(min_word_count=1) == [2]
    assert ids(max_word_count=1) == [1]
    assert ids(min_quality_score=0.5) == [2]
    assert ids(category="a") == [2] and ids(category="b") == []
    assert ids(has_errors=True) == [2] and ids(has_errors=False) == [1]
    assert ids() == [1, 2]


def test_filter_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame(
        [(i, "job", i * 10, 0.5, "a") for i in range(20)],
        "content_id int, job_id string, word_count bigint, quality_score double, category string",
    )
    df.write.partitionBy("job_id").parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c")).filter(
        FilterSpec.parse({"max_word_count": 50, "category": "a"}).column() & (F.col("job_id") == "job")
    )
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = stored.select("content_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(job_id" in plan
    assert "EqualTo(category,a)" in plan and "Or(LessThanOrEqual(word_count,50),IsNull(word_count))" in plan
    assert "quality_score" not in plan.split("ReadSchema")[1]
