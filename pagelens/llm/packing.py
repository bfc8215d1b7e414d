"""Packing of tokenised texts into sequences of fixed length, online and in bounded space.

Each partition of the input is packed as it is read, without a shuffle. It keeps `open_windows`
windows open. Texts of a window's length or more fill windows of their own; what is left
of a text goes into the open window that it fills best. If none has room, the fullest is
emitted: a gap of `min_cut` tokens or more is first filled with the beginning of the
piece, a smaller gap stays and becomes padding. At its end a partition leaves its open windows,
which are merged between partitions: groups of leftovers are packed whole, best fit decreasing,
group by group of bounded size, until one group is left. Only leftover windows' numbers and lengths,
not their tokens, take part in merging.

The pieces are written to the shared folder once, so all later steps see the same numbers;
a lost task packs the same rows again. Window numbers are made of partition and count.

Results for odd input: null and empty texts are the end id alone; a text of any length is cut
into windows; repeated rows are packed each; an empty table gives no pieces; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagelens.llm.shipping import map_arrow, ship
from pagelens.llm.tokens import encoder, with_end
from pagelens.llm.words import slices
from pagelens.session import scratch_path

LENGTH = 2048
OPEN_WINDOWS = 64
MIN_CUT = 32
#: Leftover windows of this many partitions or groups are merged by one task.
MERGE_GROUP = 64
SLICE_BYTES = 4 << 20


class Packer:
    """One partition's windows. A piece is (row, start, length); a window (number, pieces)."""

    def __init__(self, length: int, open_windows: int, min_cut: int):
        self.length, self.most, self.min_cut = length, open_windows, min_cut
        self.room: list[tuple[int, int]] = []  # (free, number), ascending: best fit is the first with room
        self.pieces: dict[int, list] = {}
        self.opened = 0

    def _open(self) -> int:
        self.opened += 1
        self.pieces[self.opened - 1] = []
        return self.opened - 1

    def _put(self, number: int, free: int, piece: tuple) -> Iterator[tuple[int, list]]:
        self.pieces[number].append(piece)
        if free > piece[2]:
            insort(self.room, (free - piece[2], number))
        else:
            yield number, self.pieces.pop(number)

    def add(self, row, tokens: int) -> Iterator[tuple[int, list]]:
        """Place a text; yields windows that are thereby finished."""
        at = 0
        while tokens - at >= self.length:
            yield from self._put(self._open(), self.length, (row, at, self.length))
            at += self.length
        while at < tokens:
            left = tokens - at
            i = bisect_left(self.room, (left, -1))
            if i < len(self.room):
                free, number = self.room.pop(i)
                yield from self._put(number, free, (row, at, left))
                return
            if len(self.room) >= self.most:
                free, number = self.room.pop(0)
                if free >= self.min_cut:
                    yield from self._put(number, free, (row, at, free))
                    at += free
                else:
                    yield number, self.pieces.pop(number)
            else:
                yield from self._put(self._open(), self.length, (row, at, left))
                return

    def rest(self) -> Iterator[tuple[int, list]]:
        for _, number in self.room:
            yield number, self.pieces.pop(number)


def _merge(group: pd.DataFrame, length: int) -> pd.DataFrame:
    """Best fit decreasing of whole leftover windows: each gets the window it joins and its offset there."""
    room: list[tuple[int, int]] = []
    into, offset = [], []
    group = group.sort_values(["filled", "window"], ascending=[False, True])
    for window, filled in zip(group["window"].tolist(), group["filled"].tolist()):
        i = bisect_left(room, (filled, -1 << 62))
        free, target = room.pop(i) if i < len(room) else (length, window)
        into.append(target)
        offset.append(length - free)
        if free > filled:
            insort(room, (free - filled, target))
    return pd.DataFrame({"window": group["window"], "into": into, "offset": offset, "filled": group["filled"]})


def pack(
    df: DataFrame, key: str, text: str, model: str, pieces: str, end: int,
    length: int = LENGTH, open_windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT, merge_group: int = MERGE_GROUP,
) -> DataFrame:
    """One row per piece: key, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    `model` is a tokenizer file's content and `pieces` its rule (see `tokens`). Windows shorter than `length`
    are to be padded by whoever lays them out.
    """
    spark = df.sparkSession
    ship(spark)
    slim = df.select(F.spark_partition_id().cast("bigint").alias("part"), F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType(
        [T.StructField("key", slim.schema["key"].dataType)]
        + T._parse_datatype_string(
            "start bigint, length bigint, doc_tokens bigint, window bigint, offset bigint, ids binary, leftover boolean"
        ).fields
    )
    arrow = to_arrow_schema(schema)
    sent = spark.sparkContext.broadcast(model)

    def batch_of(windows: list[tuple[int, list, bool]], part: int) -> pa.RecordBatch:
        rows = []
        for number, own, leftover in windows:
            at = 0
            for (doc, ids), start, size in own:
                rows.append((doc, start, size, len(ids), (part << 32) | number, at, ids[start : start + size].tobytes(), leftover))
                at += size
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches):
        tool, packer, part = encoder(sent.value, pieces), Packer(length, open_windows, min_cut), 0
        for batch in slices(batches, "text", SLICE_BYTES):
            part = batch.column("part")[0].as_py()
            ids, offsets = with_end(*tool.encode(batch.column("text")), end)
            done = []
            for doc, a, b in zip(batch.column("key").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                # A copy, so that an open window keeps its own tokens and not the whole slice.
                done += [(n, own, False) for n, own in packer.add((doc, ids[a:b].copy()), b - a)]
            if done:
                yield batch_of(done, part)
        done = [(n, own, True) for n, own in packer.rest()]
        if done:
            yield batch_of(done, part)

    path = scratch_path(spark, "pieces")
    map_arrow(slim, run, schema).write.partitionBy("leftover").parquet(path)
    written = spark.read.schema(schema).parquet(path)
    rest = written.filter("leftover")
    moved = _merged_leftovers(rest, length, merge_group)
    whole = written.filter("not leftover").withColumn("sequence_id", F.col("window"))
    joined = rest.join(moved, "window").select(
        "key", "start", "length", "doc_tokens", F.col("into").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"), "ids"
    )
    names = ["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    return whole.select(*names).union(joined.select(*names)).withColumnRenamed("key", key)


def _merged_leftovers(rest: DataFrame, length: int, merge_group: int) -> DataFrame:
    """(window, into, shift): where each leftover window ends up, as a written table."""
    spark = rest.sparkSession

    def written(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "leftovers")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    moved = written(
        rest.groupBy("window").agg(F.sum("length").alias("filled")).select(
            "window", F.col("window").alias("into"), F.lit(0).cast("bigint").alias("shift"), "filled",
            F.shiftright("window", 32).alias("part"),
        )
    )
    parts = (moved.agg(F.max("part")).first()[0] or 0) + 1
    schema = "window bigint, into bigint, offset bigint, filled bigint"
    # The first round looks at all windows of a group, at most the open ones of its partitions. Afterwards any two windows of a group
    # are too long to join, so at most one is half full or less; only such a window goes on, and meets those of other groups.
    most = length - length // 32
    while True:
        moved = moved.withColumn("part", F.floor(F.col("part") / merge_group))
        parts = -(-parts // merge_group)
        # One row per window that still stands, with its length.
        standing = moved.groupBy("into", "part").agg(F.sum("filled").alias("filled")).withColumnRenamed("into", "window")
        wanted = standing.filter(F.col("filled") <= most)
        most = length // 2
        step = wanted.groupBy("part").applyInPandas(lambda g: _merge(g, length), schema)
        step = step.select(F.col("window").alias("into"), F.col("into").alias("next"), F.col("offset").alias("more"))
        moved = written(
            moved.join(step, "into", "left").select(
                "window", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"),
                "filled", "part",
            )
        )
        if parts <= 1:
            return moved.select("window", "into", "shift")
