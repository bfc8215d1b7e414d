"""Token ids in directly addressable variable-length codes, with random access to any token.

A file holds the ids of whole texts one after another. An id is cut into chunks of
`WIDTH` bits, low bits first. Level 0 has the first chunk of every id, level 1 the second
chunk of those ids that need one, and so on. A level's continuation bitmap tells which of its
chunks go on, and its rank directory the number of set bits before every `RANK_BITS` bits,
so the place of a token's next chunk is a rank: one directory entry and the bits after it. A range
of tokens reads just its slices of each level; nothing else is decoded.

Layout, all little-endian: `HEADER` (magic, version, texts, tokens, levels), text keys (8 bytes each),
a byte for each key (0: null), token offsets of the texts (8 bytes each, one more than texts), then the
number of chunks of each level, and for each level its chunks (a byte each), its bitmap and its
directory (8 bytes each).

Tasks write to names that hold their attempt, and only names in the manifest, which Spark commits, count: a
task that is run again or twice leaves files that nothing reads. Readers open the files through
`pyarrow.fs`, so the shared folder may be any store it knows.

Results for odd input: null and empty texts are the end id alone; null keys come first; repeated keys follow one
another by text; an empty table gives no files and no rows; keys are integers and other columns are not looked at.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from pagelens.llm.shipping import map_arrow
from pagelens.llm.tokens import encoder, with_end
from pagelens.llm.words import slices
from pagelens.session import scratch_path

MAGIC, VERSION = b"PLDC", 1
HEADER = struct.Struct("<4sIQQQ")
WIDTH = 8
RANK_BITS = 512
#: Tokens of a file, unless one text has more; it bounds a task's memory.
FILE_TOKENS = 4 << 20

MANIFEST = "part bigint, nth bigint, path string, n_docs bigint, n_tokens bigint"


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, directory) of each level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> WIDTH > 0
        counts = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        directory = np.concatenate([[0], np.cumsum(counts)]).astype("<i8")
        levels.append(((rest & ((1 << WIDTH) - 1)).astype(np.uint8), np.packbits(more, bitorder="little"), directory))
        rest = rest[more] >> WIDTH
        if not len(rest):
            return levels


def file_bytes(keys: list, ids: np.ndarray, offsets: np.ndarray) -> bytes:
    levels = encode_levels(ids)
    parts = [
        HEADER.pack(MAGIC, VERSION, len(keys), len(ids), len(levels)),
        np.array([0 if k is None else k for k in keys], dtype="<i8").tobytes(),
        np.array([k is not None for k in keys], dtype=np.uint8).tobytes(),
        offsets.astype("<i8").tobytes(),
        np.array([len(chunks) for chunks, _, _ in levels], dtype="<i8").tobytes(),
    ]
    for level in levels:
        parts += [x.tobytes() for x in level]
    return b"".join(parts)


class TokenFile:
    """Random access to one file; reads only what a request needs."""

    def __init__(self, path: str):
        fs, name = open_store(path)
        self.file = fs.open_input_file(name)
        magic, version, self.n_docs, self.n_tokens, n_levels = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError(f"{path} is not a token file of version {VERSION}")
        at = HEADER.size
        self.keys_at, at = at, at + 8 * self.n_docs
        self.valid_at, at = at, at + self.n_docs
        self.offsets_at, at = at, at + 8 * (self.n_docs + 1)
        sizes, at = self._array(at, n_levels, "<i8"), at + 8 * n_levels
        self.levels = []
        for n in sizes.tolist():
            bits, ranks = at + n, at + n + (n + 7) // 8
            self.levels.append((at, bits, ranks))
            at = ranks + 8 * (-(-n // RANK_BITS) + 1)

    def _array(self, at: int, n: int, kind: str) -> np.ndarray:
        kind = np.dtype(kind)
        return np.frombuffer(self.file.read_at(n * kind.itemsize, at), dtype=kind)

    def keys(self) -> list:
        valid = self._array(self.valid_at, self.n_docs, "u1")
        return [k if v else None for k, v in zip(self._array(self.keys_at, self.n_docs, "<i8").tolist(), valid.tolist())]

    def offsets(self, doc: int = 0, to: int | None = None) -> np.ndarray:
        to = self.n_docs if to is None else to
        return self._array(self.offsets_at + 8 * doc, to - doc + 1, "<i8")

    def _bits(self, at: int, start: int, stop: int) -> np.ndarray:
        first = start // 8
        raw = self._array(at + first, (stop + 7) // 8 - first, "u1")
        return np.unpackbits(raw, bitorder="little")[start - 8 * first : stop - 8 * first].astype(bool)

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit i of a level."""
        _, bits, ranks = self.levels[level]
        block = i // RANK_BITS
        before = int(self._array(ranks + 8 * block, 1, "<i8")[0])
        return before + int(self._bits(bits, block * RANK_BITS, i).sum())

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids from `start` to `stop`, counted in this file."""
        out = np.zeros(stop - start, dtype=np.uint32)
        where = np.arange(stop - start)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if start >= stop:
                break
            out[where] |= self._array(chunks + start, stop - start, "u1").astype(np.uint32) << (WIDTH * level)
            more = self._bits(bits, start, stop)
            start, where = self._rank(level, start), where[more]
            stop = start + len(where)
        return out

    def close(self) -> None:
        self.file.close()


def open_store(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def write_files(
    df: DataFrame, key: str, text: str, model: str, pieces: str, end: int, folder: str | None = None, file_tokens: int = FILE_TOKENS
) -> DataFrame:
    """Write token files in ascending key order; returns the manifest (part, nth, path, n_docs, n_tokens, start).

    `start` is the number of tokens in all files before.
    """
    spark = df.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    sent = spark.sparkContext.broadcast(model)
    slim = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    ordered = slim.repartitionByRange(F.col("key"), F.xxhash64("text")).sortWithinPartitions("key", "text")
    manifest = _parse_datatype_string(MANIFEST)
    arrow = to_arrow_schema(manifest)

    def run(batches):
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        fs, base = open_store(folder)
        tool = encoder(sent.value, pieces)

        def store(nth: int, keys: list, held: list) -> pa.RecordBatch:
            ids = np.concatenate([x for x, _ in held])
            sizes = np.concatenate([np.diff(o) for _, o in held])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            name = f"tokens-{part:06d}-{nth:06d}-{attempt}.pldc"
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(file_bytes(keys, ids, offsets))
            row = [part, nth, f"{folder}/{name}", len(keys), len(ids)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

        nth, keys, held, size = 0, [], [], 0
        for batch in slices(batches, "text"):
            ids, offsets = with_end(*tool.encode(batch.column("text")), end)
            if held and size + len(ids) > file_tokens:
                yield store(nth, keys, held)
                nth, keys, held, size = nth + 1, [], [], 0
            keys += batch.column("key").to_pylist()
            held.append((ids, offsets))
            size += len(ids)
        if held:
            yield store(nth, keys, held)

    path = scratch_path(spark, "manifest")
    map_arrow(ordered, run, manifest).write.parquet(path)
    written = spark.read.schema(manifest).parquet(path)
    # One row per file of millions of tokens: small enough for one task at any corpus size.
    before = W.orderBy("part", "nth").rowsBetween(W.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("bigint")))


def read_files(manifest: DataFrame, key: str) -> DataFrame:
    """(key, start, n_tokens, ids as little-endian unsigned 32-bit integers) of every text, read from the files."""
    schema = _parse_datatype_string("key bigint, start bigint, n_tokens bigint, ids binary")
    arrow = to_arrow_schema(schema)
    # A number given is kept: left alone, so few small rows would be read by one task.
    spread = manifest.select("path", "start").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")

    def texts(path: str, start: int) -> Iterator[pa.RecordBatch]:
        file = TokenFile(path)
        keys, offsets, at = file.keys(), file.offsets(), 0
        while at < file.n_docs:
            # Texts of a few megabytes at a time.
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), side="right")) - 1)
            ids = file.tokens(int(offsets[at]), int(offsets[to])).astype("<u4")
            own = offsets[at : to + 1] - offsets[at]
            rows = [
                pa.array(keys[at:to], pa.int64()),
                pa.array(offsets[at:to] + start),
                pa.array(np.diff(own)),
                pa.array([ids[a:b].tobytes() for a, b in zip(own[:-1].tolist(), own[1:].tolist())], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(rows, schema=arrow)
            at = to
        file.close()

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from texts(row["path"], row["start"])

    return map_arrow(spread, run, schema).withColumnRenamed("key", key)
