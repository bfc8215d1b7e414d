"""Duplicate detection over a corpus: copies, near copies, keep-lowest clusters.

Equal word sets are collapsed first, so a group of copies of any size costs one
row. Near copies use a prefix filter: sets with Jaccard similarity >= t must
share one of the first |x| - ceil(t|x|) + 1 tokens in any fixed token order
(Xiao et al. 2008); positions of the shared token rule out most other pairs.
Within a token's posting list each set is first compared with the list's lowest
id only, which is linear. Later rounds look only at posting lists that still
hold several clusters, so a large cluster is never paired with itself.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.text import blank_word_count, blank_words
from pagelens.operators.features import sparse_dot, tfidf_rows
from pagelens.operators.pair_blocks import BLOCK_WORDS, near_pairs
from pagelens.operators.skew import HOT_ROWS, lookup
from pagelens.session import bounded_broadcast, discard, written

# Number of hash buckets in the token frequency table: one byte each, so its size is fixed.
BUCKETS = 1 << 18
PAIR_BLOCK = 4096
#: Memory of the texts that one task of a pair comparison holds.
BLOCK_BYTES = 32 << 20


def word_set(text: Column) -> Column:
    """Sorted distinct lower-cased whitespace words."""
    return F.sort_array(F.array_distinct(blank_words(F.lower(text))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over united words of two distinct-word arrays, 0 for two empty sets."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared.cast("double") / union.cast("double")).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """M6 over dense arrays; 0 when either norm is 0."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
        )

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def exact_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """M9, exact part: one row per repeated text (hash, lowest id, copies); partial sums before the shuffle."""
    return (
        df.select(key, F.sha2(F.lower(F.trim(text)), 256).alias("hash"))
        .groupBy("hash")
        .agg(F.min(key).alias("keeper"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )


def _written(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared folder; survives the loss of any executor.

    For wide or often read steps: later reads are columnar and pruned, and the known
    size lets a join with a small table skip its shuffle.
    """
    return written(df, "step", "zstd")


def _cut(df: DataFrame) -> DataFrame:
    """Cut lineage of pairs and edges, read whole once or twice: with a table, so that what was shuffled for them goes at once."""
    return written(df, "edges")


def components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, label): the lowest id connected to each node of undirected edges (a, b).

    Alternates large-star and small-star rounds (Kiveris et al. 2014) until the
    edge set stops changing; the number of rounds is logarithmic in practice and
    not capped. Hub nodes are handled by `lookup`.
    """
    current = _cut(
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct()
    )

    def fingerprint(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        return tuple(row)

    def star(both: DataFrame, rows: int) -> DataFrame:
        """Attach to each (u, v) the lowest of u and its listed neighbours."""
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        return lookup(both, low, "u", hot_rows, rows)

    mark = fingerprint(current)
    while True:
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(current.select("lo", "hi"))
        large = _cut(
            star(both, 2 * mark[0]).filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        )
        down = large.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        linked = star(down, 2 * mark[0])
        small = linked.select(F.col("v").alias("hi"), F.col("m").alias("lo")).union(linked.select("u", "m"))
        current = _cut(small.filter("hi <> lo").distinct())
        now = fingerprint(current)
        if now == mark:
            break
        mark = now
    nodes = current.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
    roots = current.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    return nodes.union(roots)


def _frequency_bytes(sets: DataFrame) -> bytearray:
    """One byte per hash bucket: four times the binary log of the documents that hold a token of it.

    At most BUCKETS rows reach the driver, whatever the corpus.
    """
    bucket = F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int")
    counts = sets.select(F.explode("words").alias("w")).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.select("b", F.least(F.floor(F.log2("n") * 4), F.lit(255)).cast("int").alias("v")).toArrow()
    out = np.zeros(BUCKETS, dtype=np.uint8)
    out[rows["b"].to_numpy()] = rows["v"].to_numpy()
    return bytearray(out.tobytes())


def _prefixes(sets: DataFrame, threshold: float, frequency: bytearray | None = None) -> DataFrame:
    """(token, pos, id, size): the prefix tokens of each set, rare tokens first.

    The order only has to be the same for all sets; the frequency table makes it
    rare-first, so that common tokens almost never become join keys.
    """
    table = F.lit(frequency or _frequency_bytes(sets))
    size = F.size("words")
    length = size - F.ceil(F.lit(threshold) * size - F.lit(1e-9)).cast("int") + 1

    def weighed(w: Column) -> Column:
        bucket = F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")
        return F.struct(F.substring(table, bucket + 1, 1).alias("f"), w.alias("w"))

    ordered = F.sort_array(F.transform("words", weighed))
    prefix = F.transform(F.slice(ordered, 1, length), lambda x: x["w"])
    return sets.select("id", size.alias("size"), F.posexplode_outer(prefix).alias("pos", "token"))


def _marks(sets: DataFrame) -> DataFrame:
    """(id, size, marks), written: a bitmap of at least a bit a word, in which each word turns over the bit of its hash.

    A bitmap has a power of two of 64-bit parts, so the longer of two folds to the length of the shorter by xor.
    Rows of a repeated id have a bitmap each: merged, their words would turn bits back.
    """
    size = F.size("words")
    parts = F.when(size <= 64, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(size / F.lit(64.0))))).cast("int")

    def turned(w: Column) -> Column:
        bit = F.pmod(F.xxhash64(w), parts.cast("bigint") * 64)
        mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(bit, F.lit(64)).cast("int"))
        return F.struct(F.floor(bit / 64).cast("int").alias("i"), mask.alias("part"))

    blank = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(i.alias("i"), F.lit(0).cast("bigint").alias("part")))
    rows = sets.withColumn("nth", F.monotonically_increasing_id())
    bits = rows.select("id", "nth", size.alias("size"), F.inline(F.concat(F.transform("words", turned), blank)))
    merged = bits.groupBy("id", "nth", "size", "i").agg(F.bit_xor("part").alias("part"))
    listed = merged.groupBy("id", "nth", "size").agg(F.sort_array(F.collect_list(F.struct("i", "part"))).alias("x"))
    return _written(listed.select("id", "size", F.col("x.part").alias("marks")))


def _least_difference(a: str, b: str) -> Column:
    """Bits in which two bitmaps differ: at most the number of words that are in one set only. 0 if one is over twice as long."""

    def apart(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)

    def folded(x: str) -> Column:
        half = F.floor(F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    return (
        F.when(F.size(a) == F.size(b), apart(F.col(a), F.col(b)))
        .when(F.size(a) == 2 * F.size(b), apart(folded(a), F.col(b)))
        .when(2 * F.size(a) == F.size(b), apart(F.col(a), folded(b)))
        .otherwise(F.lit(0))
    )


def _of_pairs(rows: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The `rows` whose id is in a pair, written: the wide rows travel once at most, and not at all for few ids."""
    ids = _written(pairs.select(F.explode(F.array(a, b)).alias("id")).distinct())
    found = _written(rows.join(bounded_broadcast(ids), "id", "left_semi"))
    discard(ids)
    return found


def _with_both(pairs: DataFrame, rows: DataFrame, hot_rows: int) -> DataFrame:
    """Candidate pairs (a, b) with the columns of `rows` of both sides, as `<name>_a` and `<name>_b`; `a` may be a hub."""
    side = lambda x: rows.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in rows.columns if c != "id"])
    counted = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    return lookup(pairs, counted.join(side("a"), "a"), "a", hot_rows, pairs.count()).join(side("b"), "b")


def _similar(pairs: DataFrame, sets: DataFrame, marks: DataFrame, threshold: float, hot_rows: int) -> DataFrame:
    """Keep candidate pairs (a, b) that reach the threshold; `a` may be a hub.

    Two sets that reach it differ in a share of (1 - t) / (1 + t) of their words at most. Bitmaps, which are small, rule
    out nearly all others, so that word sets travel for little more than the pairs that are kept.
    """
    both = _with_both(pairs, marks, hot_rows)
    most = F.lit((1 - threshold) / (1 + threshold)) * (F.col("size_a") + F.col("size_b")) + F.lit(1e-6)
    likely = _cut(both.filter(_least_difference("marks_a", "marks_b") <= most).select("a", "b").distinct())
    own = _of_pairs(sets.select("id", "words"), likely, "a", "b")
    full = _with_both(likely, own, hot_rows)
    found = _cut(
        full.withColumn("similarity", jaccard(F.col("words_a"), F.col("words_b"))).filter(F.col("similarity") >= threshold).select("a", "b", "similarity")
    )
    discard(own)
    return found


def _can_match(threshold: float, size_a: str, pos_a: str, size_b: str, pos_b: str) -> Column:
    """Whether two sets can still reach the threshold when they first meet at these prefix positions.

    Similar sets always pass at their first shared token: sizes must be close, and the
    tokens from there on must suffice for the overlap that the threshold asks for.
    """
    sizes = F.least(size_a, size_b) >= F.lit(threshold) * F.greatest(size_a, size_b) - F.lit(1e-9)
    left = F.least(F.col(size_a) - F.col(pos_a), F.col(size_b) - F.col(pos_b))
    need = F.lit(threshold / (1 + threshold)) * (F.col(size_a) + F.col(size_b)) - F.lit(1e-9)
    return sizes & (left >= need)


def _stars(postings: DataFrame, n_postings: int, threshold: float, hot_rows: int) -> DataFrame:
    """Distinct (a, b): every set with the lowest id of each posting list that it is in, where the two can still match."""
    heads = _written(
        postings.groupBy("token").agg(F.min(F.struct("id", "size", "pos")).alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    stars = _cut(
        lookup(postings, heads, "token", hot_rows, n_postings)
        .filter(F.col("id") != F.col("head.id"))
        .filter(_can_match(threshold, "size", "pos", "head.size", "head.pos"))
        .select(F.col("head.id").alias("a"), F.col("id").alias("b"))
        .distinct()
    )
    discard(heads)
    return stars


def near_edges(sets: DataFrame, threshold: float, hot_rows: int = HOT_ROWS, block: int = PAIR_BLOCK) -> DataFrame:
    """Edges (a, b, similarity) that connect every cluster of `sets` (id, words) at the threshold.

    The edges connect exactly the sets that all similar pairs would connect,
    without listing the pairs inside a cluster.
    """
    postings = _written(_prefixes(sets, threshold))
    n_postings = postings.count()
    stars = _stars(postings, n_postings, threshold, hot_rows)
    marks = _marks(sets)
    first = _similar(stars, sets, marks, threshold, hot_rows)
    labels = components(first, hot_rows)
    tagged = _written(
        postings.join(labels.withColumnRenamed("node", "id"), "id", "left").select(
            "token", "pos", "id", "size", F.coalesce("label", "id").alias("label")
        )
    )
    discard(postings)
    # Posting lists of a single cluster need no further comparison. In the others the largest cluster is
    # met only by the rows outside it, so it is never paired with itself.
    by_label = tagged.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    open_lists = _written(
        by_label.groupBy("token")
        .agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("largest"))
        .filter("n > largest.n")
        .select(
            "token",
            "n",
            F.col("largest.label").alias("big"),
            F.ceil(F.col("n") / block).cast("int").alias("cells"),
            F.ceil((F.col("n") - F.col("largest.n")) / block).cast("int").alias("few"),
        )
    )
    rows = _written(lookup(tagged, open_lists, "token", hot_rows, n_postings))
    discard(tagged, open_lists)
    # Long lists are cut into a grid of cells, so no task holds more than block x block comparisons.
    def cell(n: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = rows.filter("label <> big").select(
        "token", F.col("id").alias("a"), F.col("size").alias("sa"), F.col("pos").alias("pa"),
        F.col("label").alias("la"), cell("few").alias("i"), every("cells").alias("j"), "big",
    )
    right = rows.select(
        "token", F.col("id").alias("b"), F.col("size").alias("sb"), F.col("pos").alias("pb"),
        F.col("label").alias("lb"), every("few").alias("i"), cell("cells").alias("j"),
    )
    cross = (
        left.join(right, ["token", "i", "j"])
        .filter((F.col("la") != F.col("lb")) & ((F.col("lb") == F.col("big")) | (F.col("a") < F.col("b"))))
        .filter(_can_match(threshold, "sa", "pa", "sb", "pb"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    cross = _cut(cross)
    discard(rows)
    second = _similar(cross, sets, marks, threshold, hot_rows)
    discard(marks)
    return first.union(second)


def clusters(
    df: DataFrame, key: str, text: str, threshold: float = 0.8, hot_rows: int = HOT_ROWS, block: int = PAIR_BLOCK
) -> DataFrame:
    """(id, keeper) for every document; keepers are the lowest id of each cluster.

    Documents are clustered when a chain of texts with Jaccard >= threshold joins
    them. Documents without words stay alone.
    """
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("t"))
    words = word_set(F.col("t")).alias("words")
    # 128 bits: at 10^11 documents a 64-bit key would merge unrelated sets.
    hashed = _written(rows.select("id", words).select("id", F.md5(F.array_join("words", " ")).alias("sig"), F.size("words").alias("size")))
    reps = _written(
        hashed.filter("size > 0")
        .groupBy("sig")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    )
    # The texts of the representatives travel, not their words: those are made where the texts arrive, and written once.
    sets = _written(rows.join(reps.select(F.col("rep").alias("id")), "id").select("id", words))
    edges = near_edges(sets, threshold, hot_rows, block)
    discard(sets)
    labels = components(edges, hot_rows)
    keepers = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "sig", F.coalesce("label", "rep").alias("keeper"), "n"
    )
    with_words = lookup(hashed.filter("size > 0").select("id", "sig"), keepers, "sig", hot_rows, hashed.count())
    alone = hashed.filter("size = 0").select("id", F.col("id").alias("keeper"))
    return with_words.select("id", "keeper").union(alone)


def keep_lowest(df: DataFrame, key: str, assigned: DataFrame) -> DataFrame:
    """Drop every document that is not the keeper of its cluster."""
    losers = assigned.filter("id <> keeper").select(F.col("id").alias(key))
    return df.join(losers, key, "left_anti")


def duplicate_rows(
    df: DataFrame, key: str, text: str, assigned: DataFrame, threshold: float = 0.8, hot_rows: int = HOT_ROWS, stop_words: Sequence[str] = ()
) -> DataFrame:
    """M8: one row per duplicate against its keeper, with both similarities and the decision."""
    pairs = _cut(assigned.filter("id <> keeper").select(F.col("keeper").alias("content1_id"), F.col("id").alias("content2_id")))
    return score_pairs(pairs, df, key, text, threshold, hot_rows, stop_words)


def profiles(df: DataFrame, key: str, text: str, stop_words: Sequence[str] = (), pairs: DataFrame | None = None) -> DataFrame:
    """(id, words: distinct, length: all words, indices, weights: TF-IDF of unit length), written once for any number of pairs.

    With `pairs` only texts that are in one have a row; term weights are of the whole corpus all the same.
    """
    base = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = tfidf_rows(base, "id", "t", stop_words)
    weights = found.rows
    if pairs is not None:
        ids = bounded_broadcast(_written(pairs.select(F.explode(F.array("content1_id", "content2_id")).alias("id")).distinct()))
        base, weights = base.join(ids, "id", "left_semi"), weights.join(ids, "id", "left_semi")
    sets = base.select("id", word_set(F.col("t")).alias("words"), blank_word_count(F.col("t")).alias("length"))
    out = _written(sets.join(weights, "id"))
    discard(*found.scratch)
    return out


def _blocks(own: DataFrame, hot_rows: int, block_bytes: int) -> int:
    """Blocks of texts, each of which holds about `block_bytes` in memory and `hot_rows` rows at most; one a core at least."""
    held = F.sum(24 * F.size("words") + 12 * F.size("indices") + 64)
    rows, size = own.agg(F.count(F.lit(1)), held).first()
    return max(own.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // block_bytes), -(-rows // hot_rows))


def pair_measures(pairs: DataFrame, own: DataFrame, hot_rows: int = HOT_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """M6 and M7 of given pairs (content1_id, content2_id): jaccard_similarity, cosine_similarity, length_ratio; written.

    Second texts are dealt out once, into blocks by a hash of their id. A first text travels once to each block that holds
    a partner of it, with the list of those, and meets them there: texts do not travel once a pair.
    """
    spark, n = pairs.sparkSession, _blocks(own, hot_rows, block_bytes)
    block = F.pmod(F.xxhash64("content2_id"), F.lit(n)).cast("int").alias("block")
    # Words hold no blanks, and one string is less than half of a list of words.
    slim = own.withColumn("words", F.array_join("words", " "))
    side = lambda k: slim.select(*[F.col(c).alias(f"content{k}_id" if c == "id" else f"{c}{k}") for c in own.columns])
    listed = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    partners = pairs.groupBy("content1_id", block).agg(F.collect_list("content2_id").alias("partners"))
    first = partners.join(side(1), "content1_id").repartition(n, "block").withColumn("words1", listed("words1"))
    second = side(2).select("*", block).repartition(n, "block").withColumn("words2", listed("words2"))
    met = first.withColumn("content2_id", F.explode("partners")).drop("partners").join(second.hint("shuffle_hash"), ["block", "content2_id"])
    longer = F.greatest("length1", "length2").cast("double")
    measured = met.select(
        "content1_id",
        "content2_id",
        sparse_dot("indices1", "weights1", "indices2", "weights2").alias("cosine_similarity"),
        jaccard(F.col("words1"), F.col("words2")).alias("jaccard_similarity"),
        F.when(longer > 0, F.least("length1", "length2") / longer).otherwise(F.lit(1.0)).alias("length_ratio"),
    )
    # Both sides lie by block already; joined by block and id they are not to be dealt out again, pair by pair.
    dealt = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(dealt)
    spark.conf.set(dealt, "false")
    try:
        return _written(measured)
    finally:
        spark.conf.set(dealt, before)


def score_pairs(
    pairs: DataFrame, df: DataFrame, key: str, text: str, threshold: float = 0.8, hot_rows: int = HOT_ROWS, stop_words: Sequence[str] = ()
) -> DataFrame:
    """M8 for given pairs (content1_id, content2_id): TF-IDF cosine, Jaccard, flag, confidence."""
    own = profiles(df, key, text, stop_words, pairs)
    measured = pair_measures(pairs, own, hot_rows)
    discard(own)
    return measured.select(
        "content1_id",
        "content2_id",
        "cosine_similarity",
        "jaccard_similarity",
        (F.col("jaccard_similarity") >= threshold).alias("is_duplicate"),
        F.abs(F.col("jaccard_similarity") - threshold).alias("confidence"),
        F.lit(threshold).alias("threshold_used"),
    )


def candidate_pairs(
    df: DataFrame, key: str, text: str, threshold: float = 0.4, hot_rows: int = HOT_ROWS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(content1_id, content2_id), the lower id first: every pair whose Jaccard similarity reaches the threshold, and each text
    with the lowest id that shares one of its rare words, whether similar or not.

    The second kind is linear in the posting lists. The first is all there is of it: its number grows with the square of a
    group of copies, and finding it compares blocks of sets with each other.
    """
    sets = _written(df.select(F.col(key).alias("id"), word_set(F.col(text)).alias("words")).filter(F.size("words") > 0))
    frequency = _frequency_bytes(sets)
    postings = _written(_prefixes(sets, threshold, frequency))
    stars = _stars(postings, postings.count(), threshold, hot_rows)
    hashed = sets.select("id", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    discard(postings)
    near = near_pairs(hashed, "hashes", bytes(frequency), threshold, block_words)
    out = _written(stars.union(near).distinct().select(F.col("a").alias("content1_id"), F.col("b").alias("content2_id")))
    discard(sets, stars)
    return out
