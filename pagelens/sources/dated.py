"""Exports in a folder for each day and, in it, for each job, with a manifest of what was written when."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pagelens.sources.tables import list_files

FOLDER = ["year", "month", "day", "job_id"]
#: What a written file's name ends in.
ENDINGS = {"json": "json", "csv": "csv", "text": "txt", "parquet": "parquet"}
MANIFEST = (
    "year string, month string, day string, job_id string, files bigint, bytes bigint, record_count bigint, format string, exported_at timestamp_ntz"
)


def with_folders(df: DataFrame, at: str, job: str) -> DataFrame:
    """`df` and its folder columns, from a time and a job column; rows without either go to Spark's default folder."""
    parts = {"year": F.date_format(at, "yyyy"), "month": F.date_format(at, "MM"), "day": F.date_format(at, "dd")}
    return df.withColumns({**parts, "job_id": F.col(job).cast("string")})


def export_dated(df: DataFrame, at: str, job: str, path: str, fmt: str, export_id: str, exported_at: datetime, names: list[str] | None = None) -> DataFrame:
    """Write `names` (all columns by default) of the rows into their folders and return the manifest rows of this export.

    Only the folders that the rows fall into are replaced. The manifest is written after the data, so a folder without
    its row was not finished; a repeated export overwrites both. Equal folders are written by few tasks, a hot one by several.
    """
    if fmt not in ENDINGS:
        raise ValueError(f"unknown export format: {fmt}")
    spark = df.sparkSession
    rows = with_folders(df, at, job).select(*(names or [c for c in df.columns if c not in FOLDER]), *FOLDER)
    writer = rows.hint("rebalance", *FOLDER).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDER)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(f"{path}/data")
    # Counts are of the rows that went out; sizes of the files that came of them.
    counts = rows.groupBy(*FOLDER).agg(F.count(F.lit(1)).alias("record_count"))
    found = folder_sizes(spark, f"{path}/data")
    same = found[FOLDER[0]].eqNullSafe(counts[FOLDER[0]])
    for name in FOLDER[1:]:
        same = same & found[name].eqNullSafe(counts[name])
    manifest = counts.join(found, same).select(
        *[counts[name] for name in FOLDER], "files", "bytes", "record_count", F.lit(fmt).alias("format"),
        F.lit(exported_at.isoformat(sep=" ")).cast("timestamp_ntz").alias("exported_at"),
    )
    manifest.write.mode("overwrite").parquet(f"{path}/manifest/export_id={export_id}")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/export_id={export_id}")


def folder_sizes(spark: SparkSession, data: str) -> DataFrame:
    """(folder columns, files, bytes) of what lies below `data`; file content is not read."""
    names = F.regexp_extract_all("key", F.lit("=([^/]*)/"), F.lit(1))
    # Folder names hold other signs as percent codes.
    plain = F.transform(names, lambda n: F.url_decode(F.replace(n, F.lit("+"), F.lit("%2B"))))
    value = lambda i: F.nullif(F.get(F.col("n"), F.lit(i)), F.lit("__HIVE_DEFAULT_PARTITION__"))
    files = list_files(spark, data).select(F.slice(plain, -len(FOLDER), len(FOLDER)).alias("n"), "size")
    return files.groupBy(*[value(i).alias(name) for i, name in enumerate(FOLDER)]).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of each folder over all exports."""
    rows = spark.read.schema(MANIFEST + ", export_id string").parquet(f"{path}/manifest")
    rest = [c for c in rows.columns if c not in FOLDER]
    return rows.groupBy(*FOLDER).agg(F.max_by(F.struct(*rest), F.struct("exported_at", "export_id")).alias("x")).select(*FOLDER, "x.*")


def read_dated(spark: SparkSession, path: str, schema: StructType, fmt: str) -> DataFrame:
    """The exported rows with their folder columns; a filter on these reads only their folders."""
    whole = StructType([*schema.fields, *[StructField(name, StringType()) for name in FOLDER]])
    reader = spark.read.schema(whole)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", True)
    return reader.format(fmt).load(f"{path}/data")


def as_files(manifest: DataFrame) -> DataFrame:
    """The manifest as (key, size, modified), for statistics and expiry by the time that the export states."""
    ending = F.element_at(F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair]), F.col("format"))
    return manifest.select(
        F.concat_ws("/", *FOLDER, F.concat(F.lit("all."), ending)).alias("key"), F.col("bytes").alias("size"), F.col("exported_at").alias("modified")
    )
