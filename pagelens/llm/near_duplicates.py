"""Near-duplicate documents by SimHash fingerprints and multi-index hashing.

A fingerprint has 64 bits in two segments of 32. Fingerprints within two bits of each
other differ by at most one bit in the first segment, or not at all in the second. So
each distinct fingerprint looks up its second segment, and the ball of radius one
around its first; what the tables return is verified on all 64 bits. A ball key with a
bit cleared is left to the partner that has the bit clear, which halves the look-ups.

A bucket of the tables with more than `bucket` fingerprints would pair them all. Its
members, and those that look into it, are linked another exact way: each enumerates the
ball of radius one around its whole fingerprint, two fingerprints link exactly if their
balls meet, and all that meet in one point link to its lowest member. A point has at most
65 members, so this is linear and no bucket is ever paired with itself. Copies cost one
fingerprint. Only 64-bit numbers are shuffled.

Results for odd input: null and blank texts have fingerprint zero and link like any
other; repeated rows are copies; a null id never becomes a component's id unless all of
its ids are null; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.llm.shipping import map_arrow
from pagelens.llm.words import LOWERED, Words, slices, split_words, texts_of
from pagelens.operators.duplicates import components
from pagelens.operators.skew import lookup
from pagelens.session import bounded_broadcast, scratch_path

SHINGLE = 3
SEED = 42
#: Fingerprints of a table bucket that may be compared one by one.
BUCKET = 16
HOT_ROWS = 10_000
#: Rows whose places are kept in one bitmap, 64 to a word.
SPAN = 4096
#: Shingles whose bits are counted at once: 64 bytes each.
CHUNK = 1 << 17
SLICE_BYTES = 4 << 20


def shingle_bounds(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, text) of each shingle; shorter texts are one shingle, texts without words none."""
    n = np.diff(words.docs)
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    text = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = words.docs[:-1][text] + nth
    last = first + np.minimum(n, size)[text] - 1
    return words.starts[first], words.starts[last] + words.lengths[last], text


def simhash(words: Words, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """One fingerprint a text: a bit is set if it is set in over half of the shingles' hashes."""
    begin, end, text = shingle_bounds(words, size)
    n_texts = len(words.docs) - 1
    ones = np.zeros((n_texts, 64), dtype=np.int64)
    view, digest = memoryview(words.joined), xxhash.xxh64_intdigest
    for at in range(0, len(text), CHUNK):
        part = slice(at, at + CHUNK)
        hashes = np.fromiter(
            (digest(view[a:b], seed) for a, b in zip(begin[part].tolist(), end[part].tolist())), dtype="<u8", count=len(text[part])
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        owner, first = np.unique(text[part], return_index=True)
        ones[owner] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    total = np.bincount(text, minlength=n_texts)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel().view("<i8")


def with_fingerprints(df: DataFrame, text: str) -> DataFrame:
    """(row: all columns of `df` as a struct, fingerprint: bigint), without a shuffle."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    schema = T.StructType([*packed.schema.fields, T.StructField("fingerprint", T.LongType())])

    def run(batches):
        for part in slices(batches, f"row.{text}", SLICE_BYTES):
            prints = simhash(split_words(texts_of(part, f"row.{text}"), LOWERED))
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(prints)], ["row", "fingerprint"])

    return map_arrow(packed, run, schema)


def _written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Cut lineage with a table in the shared folder: any executor may be lost afterwards."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bit(i: int) -> int:
    return 1 << i if i < 63 else -(1 << 63)


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect the distinct `fingerprint`s within two bits of each other.

    Every connected set is connected by the edges; inside dense buckets not every linked pair is listed.
    """
    fp = F.col("fingerprint")
    high, low = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))
    entry = lambda table, key, exact: F.struct(F.lit(table).alias("t"), key.alias("key"), F.lit(exact).alias("exact"))
    own = [entry(0, high, True), entry(1, low, True)]
    ball = [F.when(high.bitwiseAND(F.lit(1 << i)) == 0, entry(0, high.bitwiseXOR(F.lit(1 << i)), False)) for i in range(32)]
    index = prints.select(F.explode(F.array(*own)).alias("e"), fp.alias("b")).select("e.t", "e.key", "b")
    probes = prints.select(F.explode(F.array_compact(F.array(*own, *ball))).alias("e"), fp.alias("a")).select("e.t", "e.key", "e.exact", "a")
    dense = _written(
        index.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).select("t", "key"), "dense"
    )
    crowded = dense.limit(1).count() > 0
    keys = bounded_broadcast(dense) if crowded else dense

    def sparse(df: DataFrame) -> DataFrame:
        return df.join(keys, ["t", "key"], "left_anti") if crowded else df

    near = (
        sparse(probes)
        .join(sparse(index), ["t", "key"])
        .filter(F.when(F.col("exact"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
        .filter(_distance("a", "b") <= 2)
        .select("a", "b")
    )
    if not crowded:
        return near.distinct()
    touched = probes.join(keys, ["t", "key"], "left_semi").select(F.col("a").alias("p")).distinct()
    points = F.array(F.col("p"), *[F.col("p").bitwiseXOR(F.lit(_bit(i))) for i in range(64)])
    balls = _written(touched, "touched").select(F.explode(points).alias("point"), "p")
    lowest = balls.groupBy("point").agg(F.min("p").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("point", "a")
    stars = balls.join(lowest, "point").filter("a <> p").select("a", F.col("p").alias("b"))
    return near.union(stars).distinct()


def label_fingerprints(rows: DataFrame, key: str = "id", bucket: int = BUCKET) -> DataFrame:
    """(fingerprint, n rows, root: its lowest fingerprint, component_id: its lowest id) of written `rows` (key, fingerprint)."""
    prints = _written(
        rows.groupBy("fingerprint").agg(F.min(key).alias("low"), F.count(F.lit(1)).alias("n")), "fingerprints"
    )
    labels = components(links(prints.select("fingerprint"), bucket))
    rooted = _written(
        prints.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
            "fingerprint", "n", "low", F.coalesce("label", "fingerprint").alias("root")
        ),
        "rooted",
    )
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return _written(rooted.join(lowest, "root").select("fingerprint", "n", "root", "component_id"), "labels")


def near_duplicates(df: DataFrame, key: str, text: str, bucket: int = BUCKET, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, fingerprint as 16 hexadecimal digits, component_id): one row for each row of `df`."""
    rows = _written(
        with_fingerprints(df.select(F.col(key).alias("id"), F.col(text).alias("body")), "body").select("row.id", "fingerprint"), "prints"
    )
    out = lookup(rows, label_fingerprints(rows, "id", bucket), "fingerprint", hot_rows)
    return out.select(
        F.col("id").alias(key), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def _bitmaps(places: DataFrame, nth: str) -> DataFrame:
    """(span, bits: 64 to a word) of distinct numbers, one row for each `SPAN` of them that holds any."""
    word = places.groupBy(F.expr(f"{nth} div {SPAN}").alias("span"), F.expr(f"cast(pmod({nth}, {SPAN}) div 64 AS int)").alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(pmod({nth}, 64) AS int)))").alias("bits")
    )
    found = word.groupBy("span").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("found"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(SPAN // 64 - 1)), lambda i: F.coalesce(F.try_element_at("found", i), F.lit(0).cast("bigint")))
    return found.select("span", bits.alias("bits"))


def _only(rows: DataFrame, nth: str, places: DataFrame) -> DataFrame:
    """The `rows` whose number is among `places`. Bitmaps of the places travel to the rows, so no text is shuffled while they can be broadcast."""
    bits = _written(_bitmaps(places, nth), "kept")
    own = f"get(bits, cast(pmod({nth}, {SPAN}) div 64 AS int))"
    held = F.expr(f"{own} & shiftleft(1L, cast(pmod({nth}, 64) AS int)) != 0")
    return rows.withColumn("span", F.expr(f"{nth} div {SPAN}")).join(bounded_broadcast(bits), "span").filter(held)


def deduplicate(df: DataFrame, key: str, text: str, bucket: int = BUCKET, hot_rows: int = HOT_ROWS) -> DataFrame:
    """`df` with one row of each component: one that has the lowest key (nulls last), the first as read if repeated."""
    rows = _written(with_fingerprints(df, text).withColumn("nth", F.monotonically_increasing_id()), "rows", "zstd")
    slim = rows.select(F.col(f"row.`{key}`").alias("id"), "fingerprint", "nth")
    labelled = lookup(slim, label_fingerprints(slim, "id", bucket), "fingerprint", hot_rows)
    kept = labelled.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("nth").alias("nth"))
    return _only(rows, "nth", kept.select("nth")).select("row.*")
