"""Benchmark decontamination over a positional inverted index of the training texts.

The index is cut by documents into segments of bounded size, one row each: per term the
sorted token positions in the segment, as variable-length differences. A search reads
segments one at a time and needs no shuffle. A phrase is found by intersecting the
offset-adjusted position lists of its terms, from the term rarest in the segment on, so
most phrases are given up after one or two short lists. With `slop`, a proximity match is
an alignment at which the rarest word stands in its place and every other word at most
`slop` places from its own.

Only terms that some test item uses are stored. Test items are read in blocks of bounded
size; each block is one pass over the index, and the passes' matches are put together.

Results for odd input: null or wordless texts have no words, no hits and are clean; every
row of a repeated key gets its own result; test items without words match nothing, items
that share an id count once, items without an id are left out; an empty table gives an
empty result, an empty benchmark marks nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagelens.llm.shipping import map_arrow
from pagelens.llm.words import ALPHANUMERIC, from_varint, ragged_take, slices, split_words, to_varint
from pagelens.session import scratch_path

WINDOW = 13
#: Bytes of text of a segment, unless one text is longer.
SEGMENT_BYTES = 4 << 20
#: Bytes of test items that are searched for in one pass, and sent to each executor.
BLOCK_BYTES = 16 << 20

INDEX = "segment bigint, firsts array<int>, n_words array<int>, terms array<string>, counts array<int>, sizes array<int>, positions binary"


def item_blocks(items: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """`items` (id string, text) cut by id into blocks of about `block_bytes`."""
    slim = items.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // block_bytes + 1
    return [slim] if n == 1 else [slim.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == i) for i in range(n)]


def read_items(block: DataFrame) -> list[tuple[str, list[str]]]:
    """(id, words) of the items of one block that have words."""
    table = block.toArrow()
    words = split_words(table["text"], ALPHANUMERIC)
    strings = words.strings().to_pylist()
    found = [(i, strings[a:b]) for i, a, b in zip(table["id"].to_pylist(), words.docs[:-1], words.docs[1:]) if b > a]
    return sorted(set((i, tuple(w)) for i, w in found))


def build_index(df: DataFrame, key: str, text: str, slop: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The written index of all words: a row for each segment, with the keys and word counts of its texts.

    It serves every search with a slop of at most `slop`.
    """
    spark = df.sparkSession
    slim = df.select(F.spark_partition_id().cast("bigint").alias("part"), F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("keys", T.ArrayType(slim.schema["key"].dataType))] + T._parse_datatype_string(INDEX).fields)
    arrow = to_arrow_schema(schema)
    gap = slop + 1

    def run(batches):
        nth = 0
        for part in slices(batches, "text", segment_bytes):
            words = split_words(part.column("text"), ALPHANUMERIC)
            coded = words.strings().dictionary_encode()
            terms, ids = coded.dictionary, coded.indices.to_numpy()
            n = np.diff(words.docs)
            # Texts are `gap` apart, so that no match crosses from one into the next.
            firsts = words.docs[:-1] + gap * np.arange(len(n))
            at = np.arange(len(ids)) + gap * np.repeat(np.arange(len(n)), n)
            order = np.argsort(ids.astype(np.uint16 if len(terms) <= 1 << 16 else np.uint32), kind="stable")
            counts = np.bincount(ids, minlength=len(terms))
            begin = np.cumsum(counts) - counts
            steps = np.diff(at[order], prepend=0)
            steps[begin] = at[order][begin]
            positions = to_varint(steps)
            ends = np.flatnonzero(np.frombuffer(positions, dtype=np.uint8) < 128) + 1
            sizes = np.diff(ends[begin + counts - 1], prepend=0)
            segment = (part.column("part")[0].as_py() << 32) | nth
            nth += 1
            one = {
                "keys": part.column("key"), "firsts": firsts, "n_words": n, "terms": terms, "counts": counts, "sizes": sizes,
            }
            columns = {
                c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v) if isinstance(v, np.ndarray) else v)
                for c, v in one.items()
            } | {"segment": pa.array([segment]), "positions": pa.array([positions], pa.binary())}
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in arrow], schema=arrow)

    path = scratch_path(spark, "index")
    map_arrow(slim, run, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


class Items:
    """The test items of a block as numbers in one list of their terms, and all their windows."""

    def __init__(self, items: list[tuple[str, tuple[str, ...]]], window: int):
        self.ids = [i for i, _ in items]
        lengths = np.array([len(w) for _, w in items], dtype=np.int64)
        coded = pa.array([w for _, words in items for w in words], pa.large_string()).dictionary_encode()
        self.terms, self.words = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        firsts = np.cumsum(lengths) - lengths
        size = np.minimum(lengths, window)
        many = lengths - size + 1
        self.owner = np.repeat(np.arange(len(items)), many)
        inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        self.begin, self.size = firsts[self.owner] + inside, size[self.owner]

    def possible(self, known: np.ndarray) -> np.ndarray:
        """Numbers of the windows whose terms are all known."""
        missing = np.concatenate([[0], np.cumsum(~known[self.words])])
        return np.flatnonzero(missing[self.begin + self.size] == missing[self.begin])


class Segment:
    """Position lists of one index row, for the terms of a block of items only."""

    def __init__(self, row: pa.RecordBatch, items: Items):
        column = lambda c: row.column(c).flatten()
        place = pc.index_in(column("terms"), value_set=items.terms.cast(pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
        used = np.flatnonzero(place >= 0)
        counts, sizes = column("counts").to_numpy().astype(np.int64), column("sizes").to_numpy().astype(np.int64)
        raw = np.frombuffer(row.column("positions")[0].as_buffer(), dtype=np.uint8)
        steps = from_varint(ragged_take(raw, np.cumsum(sizes) - sizes, sizes, used).tobytes())
        counts = counts[used]
        ends = np.cumsum(counts)
        sums = np.cumsum(steps)
        begins = ends - counts
        sums -= np.repeat(np.where(begins > 0, sums[np.maximum(begins, 1) - 1], 0), counts)
        self.known = np.zeros(len(items.terms), dtype=bool)
        self.known[place[used]] = True
        self.lists = {t: sums[a:b] for t, a, b in zip(place[used].tolist(), begins.tolist(), ends.tolist())}

    def phrase(self, lists: list[np.ndarray], slop: int = 0) -> np.ndarray:
        """Alignments of a phrase, given its words' lists: positions at which it begins."""
        order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
        found = lists[order[0]] - order[0]
        for i in order[1:]:
            if not len(found):
                break
            there, wanted = lists[i], found + i
            at = np.searchsorted(there, wanted - slop)
            ok = at < len(there)
            ok[ok] = there[at[ok]] <= wanted[ok] + slop
            found = found[ok]
        return found

    def item(self, windows: list[list[int]], slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Merged spans (start, end) of an item's exact windows, all of one size, and starts of other proximity matches."""
        none = np.zeros(0, dtype=np.int64)
        size = len(windows[0])
        exact, near = [none], [none]
        for words in windows:
            lists = [self.lists[w] for w in words]
            found = self.phrase(lists, slop)
            if slop and len(found):
                whole = self.phrase(lists)
                near.append(found[~np.isin(found, whole)])
                found = whole
            exact.append(found)
        starts = np.unique(np.concatenate(exact))
        # Windows of one item that touch or overlap are one span.
        first = np.flatnonzero(np.diff(starts, prepend=-size - 1) > size)
        last = np.concatenate([first[1:] - 1, [len(starts) - 1]]) if len(starts) else first
        return np.stack([starts[first], starts[last] + size], axis=1), np.concatenate(near)


def search(index: DataFrame, items: list[tuple[str, tuple[str, ...]]], window: int = WINDOW, slop: int = 0) -> DataFrame:
    """A row for each indexed text: segment, nth, key, n_words, spans [item, start, end] of exact matches, near [item, start].

    Starts and ends count words of the text from 0; the end is excluded.
    """
    sent = index.sparkSession.sparkContext.broadcast(Items(items, window))
    key = index.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField("key", key)] + T._parse_datatype_string(
        "segment bigint, nth int, n_words bigint, spans array<struct<item:string,start:bigint,end:bigint>>, near array<struct<item:string,start:bigint>>"
    ).fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        block = sent.value
        for batch in batches:
            for row in (batch.slice(i, 1) for i in range(batch.num_rows)):
                segment = Segment(row, block)
                firsts = row.column("firsts").flatten().to_numpy()
                spans, near = [[] for _ in firsts], [[] for _ in firsts]
                possible = block.possible(segment.known)
                owners, at = np.unique(block.owner[possible], return_index=True)
                for owner, own in zip(owners.tolist(), np.split(possible, at[1:])):
                    item = block.ids[owner]
                    windows = [block.words[a : a + n].tolist() for a, n in zip(block.begin[own].tolist(), block.size[own].tolist())]
                    found, loose = segment.item(windows, slop)
                    for (a, b), d in zip(found.tolist(), np.searchsorted(firsts, found[:, 0], side="right") - 1):
                        spans[d].append({"item": item, "start": a - int(firsts[d]), "end": b - int(firsts[d])})
                    for a, d in zip(loose.tolist(), np.searchsorted(firsts, loose, side="right") - 1):
                        near[d].append({"item": item, "start": a - int(firsts[d])})
                n = len(firsts)
                yield pa.RecordBatch.from_arrays(
                    [
                        row.column("keys").flatten().cast(arrow.field("key").type),
                        pa.array(np.full(n, row.column("segment")[0].as_py())),
                        pa.array(np.arange(n, dtype=np.int32)),
                        row.column("n_words").flatten().cast(pa.int64()),
                        pa.array(spans, arrow.field("spans").type),
                        pa.array(near, arrow.field("near").type),
                    ],
                    schema=arrow,
                )

    return map_arrow(index, run, schema)


def contamination(
    df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str,
    window: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES, segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """A row for each row of `df`: its key, n_words, and all matches of the test items (see `search`)."""
    index = build_index(df, key, text, slop, segment_bytes)
    found = None
    for block in item_blocks(items, item_key, item_text, block_bytes):
        part = search(index, read_items(block), window, slop)
        found = part if found is None else found.unionByName(part)
    if found is not part:
        found = found.groupBy("segment", "nth").agg(
            F.first("key").alias("key"), F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("near")).alias("near"),
        )
    return found.drop("segment", "nth").withColumnRenamed("key", key)


def hit_words(spans: str) -> Column:
    """Number of words inside any span."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to"))
    return F.aggregate(
        ordered,
        zero,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["to"]), F.lit(0).cast("bigint"))).alias("n"),
            F.greatest(acc["to"], s["end"]).alias("to"),
        ),
        lambda acc: acc["n"],
    )


def marked(found: DataFrame) -> DataFrame:
    """Add n_hit, n_items, items_sha256 and contaminated (a twentieth of the words or more) to matches."""
    ids = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item"])))
    out = found.withColumns({"n_hit": hit_words("spans"), "__ids": ids})
    return out.withColumns(
        {
            "n_items": F.size("__ids").cast("bigint"),
            "items_sha256": F.sha2(F.array_join("__ids", ","), 256),
            "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")),
        }
    ).drop("__ids")
