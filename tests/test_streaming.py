"""Rows once per key, however late: batches with a key store against a plain set."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pagelens.streaming import ingest

SCHEMA = "event_id bigint, ts timestamp_ntz, v string"


def land(spark, folder, n, rows):
    spark.createDataFrame([(k, None, v) for k, v in rows], "event_id bigint, t string, v string").select(
        "event_id", (F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00")) + F.expr(f"make_dt_interval({n * 400})")).alias("ts"), "v"
    ).coalesce(1).write.parquet(f"{folder}/n={n}")


def taken(spark, folder):
    return sorted((r["event_id"] is not None, r["event_id"] or 0, r["v"]) for r in spark.read.schema(SCHEMA).parquet(f"{folder}/rows").collect())


@pytest.fixture
def run(spark, tmp_path):
    def go(stream, rows=None):
        rows = rows or spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        ingest.take_new(rows, "event_id", f"{tmp_path}/keys", f"{tmp_path}/out", f"{tmp_path}/check-{stream}", stream, buckets=4).awaitTermination()
        return sorted((r["event_id"] is not None, r["event_id"] or 0) for r in spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").collect())

    return go


def test_late_rows_stay_and_replays_go(spark, tmp_path, run):
    rng = random.Random(2)
    seen = set()
    for n in range(3):
        rows = [(rng.choice([*range(60), None]), f"b{n}") for _ in range(80)]
        land(spark, f"{tmp_path}/in", n, rows)
        seen |= {k for k, _ in rows}
        # 400 days lie between batches, so old keys come back far behind any event time seen.
        assert run("live") == sorted((k is not None, k or 0) for k in seen)
    assert run("replay") == sorted((k is not None, k or 0) for k in seen)


def test_a_repeated_batch_overwrites_itself(spark, tmp_path, run):
    land(spark, f"{tmp_path}/in", 0, [(k, "first") for k in range(20)] * 2)
    before = run("live")
    # The checkpoint is lost after the rows and keys were written: the same batch number runs again.
    rows = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
    ingest.take_new(rows, "event_id", f"{tmp_path}/keys", f"{tmp_path}/out", f"{tmp_path}/check-new", "live", buckets=4).awaitTermination()
    assert run("live") == before and len(before) == 20
    assert ingest.known_keys(spark, f"{tmp_path}/keys", LongType()).count() == 20


def test_only_touched_buckets_are_read(spark, tmp_path, run):
    land(spark, f"{tmp_path}/in", 0, [(k, "x") for k in range(200)])
    run("live")
    part = ingest.known_keys(spark, f"{tmp_path}/keys", LongType(), [1])
    assert 0 < part.count() < 200 and "PartitionFilters: [isnotnull(bucket" in part._jdf.queryExecution().toString()
    store = ingest.compact_keys(spark, f"{tmp_path}/keys", f"{tmp_path}/keys2", LongType(), buckets=4)
    rows = ingest.known_keys(spark, store, LongType())
    assert rows.count() == 200 and {r["batch"] for r in rows.select("batch").distinct().collect()} == {"compacted"}


def test_stream_state_form(spark, tmp_path):
    land(spark, f"{tmp_path}/in", 0, [(k % 5, "x") for k in range(20)])
    rows = ingest.once_per_key(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*"), "event_id")
    ingest.to_table(rows, f"{tmp_path}/rows", f"{tmp_path}/c").awaitTermination()
    assert len(taken(spark, tmp_path)) == 5
