"""Joins and numbering that hold when one key owns a large share of all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.session import bounded_broadcast, scratch_path

HOT_ROWS = 1_000_000
#: Hot keys, and bytes of their rows, that may be broadcast.
HOT_KEYS_MAX = 100_000
HOT_BYTES_MAX = 64 << 20
#: Salts of every key where there are too many hot ones to list.
SALTS = 32


def _bytes(df: DataFrame) -> int:
    """About how many bytes the rows hold, from their written form."""
    return int(df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0)


def _salted(left: DataFrame, right: DataFrame, key: str, salts: Column) -> DataFrame:
    """Join on (key, salt): `left` has the column `__salts`, `right` is repeated for each of `salts`."""
    # The row's place is part of the hash, so equal rows spread as well.
    spot = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.spark_partition_id()), F.col("__salts")).cast("int")
    many = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts.cast("int") - 1)))
    return left.withColumn("__salt", spot).drop("__salts").join(many, [key, "__salt"]).drop("__salt")


def lookup(
    left: DataFrame, right: DataFrame, key: str, hot_rows: int = HOT_ROWS, left_rows: int | None = None,
    hot_keys: int = HOT_KEYS_MAX, hot_bytes: int = HOT_BYTES_MAX,
) -> DataFrame:
    """Inner join of `left` with one row per key; `right.n` is the number of left rows of its key.

    With `left_rows` known and within `hot_rows` no key can be hot, so the plain join is used.

    Keys over `hot_rows` are few (at most rows / hot_rows). While their rows hold at most `hot_bytes`, they are
    broadcast and the hot part of `left` is never shuffled. Beyond that only the keys are broadcast, and a hot key is
    dealt out to as many salts as its rows need. All other keys are small by definition and use a plain shuffle join.
    Should even the hot keys be too many to list, every key is salted. Both inputs should be cheap to read twice
    (written or checkpointed).
    """
    if left_rows is not None and left_rows <= hot_rows:
        return left.join(right.drop("n"), key)
    hot = right.filter(F.col("n") > hot_rows)
    n_hot = hot.limit(hot_keys + 1).count()
    plain = right.drop("n")
    if n_hot == 0:
        return left.join(plain, key)
    if n_hot > hot_keys:
        return _salted(left.withColumn("__salts", F.lit(SALTS)), plain, key, F.lit(SALTS))
    parts = F.ceil(F.col("n") / hot_rows)
    keys = F.broadcast(hot.select(key, parts.alias("__salts")))
    if _bytes(hot) <= hot_bytes:
        on_hot = left.join(F.broadcast(hot.drop("n")), key)
    else:
        on_hot = _salted(left.join(keys, key), hot.withColumn("__parts", parts), key, F.col("__parts")).drop("n", "__parts")
    cold = right.filter(F.col("n") <= hot_rows).drop("n")
    on_cold = left.join(keys, key, "left_anti").join(cold, key)
    return on_hot.unionByName(on_cold)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: str, group: Sequence[str] = (), running: Mapping[str, Column] | None = None) -> DataFrame:
    """Add `position` (1-based) and running sums within each group, by a unique column.

    A plain window would sort a whole group in one task. Here the rows are written once, dealt out by ranges of (group, order),
    so a hot group spans as many partitions as its rows need, whatever its ids look like. Sorted partitions number their
    rows; the totals of each partition and group (groups + partitions rows) are prefixed and joined back as offsets.
    Null groups are a group.
    """
    running = dict(running or {})
    group = list(group)
    once = _written(df.withColumns({f"__{k}": c for k, c in running.items()}), "numbered")
    ranged = once.repartitionByRange(*group, order).sortWithinPartitions(*group, order)
    rows = _written(
        ranged.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row")), "ranged"
    )
    totals = rows.groupBy(*group, "__part").agg(
        F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__rows"), *[F.sum(f"__{k}").alias(f"__sum_{k}") for k in running]
    )
    before = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda name: F.coalesce(F.sum(name).over(before), F.lit(0))
    offsets = totals.select(
        *[F.col(g).alias(f"__of_{g}") for g in group],
        F.col("__part").alias("__of_part"),
        (so_far("__rows") - F.col("__first") + 1).alias("__shift"),
        *[so_far(f"__sum_{k}").alias(f"__{k}_before") for k in running],
    )
    if running:
        inside = W.partitionBy(*group, "__part").orderBy("__row").rowsBetween(W.unboundedPreceding, 0)
        rows = rows.withColumns({f"__run_{k}": F.sum(f"__{k}").over(inside) for k in running})
    same = F.col("__part") == F.col("__of_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    return rows.join(bounded_broadcast(_written(offsets, "offsets")), same).select(
        *df.columns,
        (F.col("__row") + F.col("__shift")).alias("position"),
        *[(F.col(f"__run_{k}") + F.col(f"__{k}_before")).alias(k) for k in running],
    )
