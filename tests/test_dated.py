"""Dated exports: values come back, a job's new export replaces its own folders only, and the manifest follows."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from pagelens.operators.retention import expired_files, file_statistics
from pagelens.sources import dated

ROWS = [
    (1, "a b/c+d", dt.datetime(2024, 3, 1, 5), 'x,"y"\nz'), (2, "a b/c+d", dt.datetime(2024, 3, 2), None), (3, "other", dt.datetime(2024, 3, 1), "é"),
    (4, "other", dt.datetime(2024, 3, 1, 23), ""), (5, None, dt.datetime(2024, 3, 1), "no job"),
]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "id bigint, job string, at timestamp_ntz, text string")


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.startswith("part-")}


@pytest.mark.parametrize("fmt", ["json", "csv", "parquet"])
def test_values_come_back(spark, df, tmp_path, fmt):
    manifest = dated.export_dated(df, "at", "job", str(tmp_path), fmt, "e1", dt.datetime(2024, 3, 5), ["id", "text"])
    back = dated.read_dated(spark, str(tmp_path), df.select("id", "text").schema, fmt).collect()
    empty = "" if fmt != "csv" else None  # CSV has one form for both
    want = {(i, t if t else (empty if t == "" else None), f"{at:%d}", job) for i, job, at, t in ROWS}
    assert {(r["id"], r["text"], r["day"], r["job_id"]) for r in back} == want
    sizes = {(r["day"], r["job_id"]): (r["record_count"], r["bytes"]) for r in manifest.collect()}
    assert {k: n for k, (n, _) in sizes.items()} == {("01", "a b/c+d"): 1, ("02", "a b/c+d"): 1, ("01", "other"): 2, ("01", None): 1}
    assert sum(b for _, b in sizes.values()) == sum(os.stat(p).st_size for p in files(f"{tmp_path}/data"))


def test_a_new_export_replaces_its_own_folders(spark, df, tmp_path):
    path = str(tmp_path)
    dated.export_dated(df, "at", "job", path, "json", "e1", dt.datetime(2024, 3, 5), ["id"])
    before = files(f"{path}/data")
    again = df.filter("job = 'other'").withColumn("id", F.col("id") + 100)
    dated.export_dated(again, "at", "job", path, "json", "e2", dt.datetime(2024, 3, 20), ["id"])
    after = files(f"{path}/data")
    kept = {p: t for p, t in before.items() if "job_id=other" not in p}
    assert kept.items() <= after.items() and not {p for p in before if "job_id=other" in p} & set(after)
    back = dated.read_dated(spark, path, df.select("id").schema, "json")
    assert sorted(r["id"] for r in back.collect()) == [1, 2, 5, 103, 104]
    latest = {(r["day"], r["job_id"]): r["export_id"] for r in dated.read_manifest(spark, path).collect()}
    assert latest == {("01", "a b/c+d"): "e1", ("02", "a b/c+d"): "e1", ("01", "other"): "e2", ("01", None): "e1"}
    listed = dated.as_files(dated.read_manifest(spark, path))
    gone = expired_files(listed, F.lit("2024-03-21 00:00:00").cast("timestamp_ntz"))
    assert gone.count() == 3 and listed.count() == 4
    assert [r["extension"] for r in file_statistics(listed).collect()] == [".json"]


def test_unknown_format_and_no_rows(spark, df, tmp_path):
    with pytest.raises(ValueError):
        dated.export_dated(df, "at", "job", str(tmp_path), "xlsx", "e", dt.datetime(2024, 1, 1))
