"""Session-level helpers: settings, shared folders, and size-checked physical choices."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 100_000


def local_session(cores: str = "8", app: str = "pagelens") -> SparkSession:
    """A single-machine session for tests and bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="pagelens-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's `spark.checkpoint.dir`.

    Only a local master falls back to a temporary folder; on a cluster a
    machine-local path would be lost with its executor, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    existing = spark.sparkContext.getCheckpointDir()
    return existing.rstrip("/") if existing else tempfile.mkdtemp(prefix="pagelens-")


def use_checkpoints(spark: SparkSession) -> None:
    """Give the context a reliable checkpoint folder unless it already has one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, never reused between runs."""
    return f"{shared_dir(spark)}/pagelens/{name}-{uuid.uuid4().hex}"


#: Whether shuffle files go as soon as the command that made them is done.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The rows as a table in the shared folder: what is read several times is computed once.

    What was shuffled for it is in the table, so the shuffle's files are not kept until the driver's memory is cleaned up.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing reads any more, so that scratch holds what is in use only."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if "/pagelens/" not in folder:
                raise ValueError(f"not a scratch table: {folder}")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core when the input has fewer splits than the cluster has cores.

    Text work is CPU bound, so a small single-row-group file would otherwise run
    in one task. Inputs with enough splits are returned untouched: no shuffle.
    Meant for scans: counting the partitions of a plan with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint only after counting at most `max_rows + 1` rows; else a plain join side."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
