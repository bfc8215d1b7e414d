"""Running Arrow functions of this package on executors that do not have it installed."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()
#: Bytes of one Arrow batch where the session names none: rows alone would put thousands of long texts into one.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "16m"


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all executors, once an application, as `--py-files` would; bound Arrow batches in bytes."""
    unset = "1b"
    if spark.conf.get(BATCH_SETTING, unset) == unset:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="pagelens-")) / "pagelens-sources.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"{root.name}/{path.relative_to(root)}")
    spark.sparkContext.addPyFile(str(archive))
    _sent.add(app)


def trim() -> None:
    """Give freed memory back: a worker outlives its task, and what it keeps is lost to the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not with every C library
        pass


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    ship(df.sparkSession)

    def trimmed(batches):
        yield from run(batches)
        trim()

    return df.mapInArrow(trimmed, schema)
