"""What travels for candidate pairs: bitmaps for all of them, wide rows for those in doubt or in a pair only."""

import random

from pagelens.operators import duplicates as dup

SCHEMA = "id bigint, words array<string>"


def _sets(rng, n=60):
    """Sets of sizes around the bitmap lengths; neighbours are near copies, and every set holds one common rare word."""
    out = []
    for i in range(n):
        size = rng.choice([3, 20, 63, 64, 65, 80, 128, 129, 300])
        own = [f"w{rng.randrange(4000)}" for _ in range(size)]
        out.append({"shared", *own})
        out.append({"shared", *own[: max(1, int(size * rng.choice([0.78, 0.8, 0.85, 0.95])))], *(f"x{rng.randrange(4000)}" for _ in range(size // 20))})
    return [(i, sorted(s)) for i, s in enumerate(out)]


def test_only_pairs_in_doubt_compare_words(spark, monkeypatch):
    rows = _sets(random.Random(5))
    sets = spark.createDataFrame(rows, SCHEMA).persist()
    near = [(a, b) for a, x in rows for b, y in rows if a < b and min(len(x), len(y)) >= 0.8 * max(len(x), len(y))]
    pairs = dup._cut(spark.createDataFrame(near, "a bigint, b bigint"))
    seen = []

    def spy(wide, likely, *names, _of_pairs=dup._of_pairs):
        seen.append(likely.count())
        return _of_pairs(wide, likely, *names)

    monkeypatch.setattr(dup, "_of_pairs", spy)
    for hot_rows in (10_000_000, 20):
        got = {(r["a"], r["b"]) for r in dup._similar(pairs, sets, dup._marks(sets), 0.8, hot_rows).collect()}
        want = {(a, b) for a, x in rows for b, y in rows if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.8}
        assert got == want and len(want) > 20
    assert max(seen) < len(near) / 4


def test_difference_of_bitmaps_is_a_lower_bound(spark):
    rows = _sets(random.Random(6), 25)
    sets = spark.createDataFrame(rows, SCHEMA)
    marks = dup._marks(sets).persist()
    assert {r["id"]: r["size"] for r in marks.collect()} == {i: len(w) for i, w in rows}
    both = marks.toDF("a", "sa", "ma").crossJoin(marks.toDF("b", "sb", "mb"))
    of = {i: set(w) for i, w in rows}
    for r in both.select("a", "b", dup._least_difference("ma", "mb").alias("d")).collect():
        assert r["d"] <= len(of[r["a"]] ^ of[r["b"]])


def test_repeated_ids_keep_their_links(spark):
    """An id that comes twice, with the same text or another one, links whatever any of its rows links."""
    rng = random.Random(8)
    first, other = ([f"{p}{rng.randrange(9000)}" for _ in range(100)] for p in "uv")
    rows = [(1, " ".join(first)), (1, " ".join(first)), (2, " ".join(first[:95])), (3, " ".join(other)), (2, " ".join(other[:96]))]
    got = set(map(tuple, dup.clusters(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()))
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_profiles_of_paired_texts_only(spark):
    df = spark.createDataFrame([(i, f"alpha beta {'gamma ' * (i % 3)}word{i}") for i in range(12)], "doc_id bigint, text string")
    pairs = spark.createDataFrame([(1, 4), (1, 7)], "content1_id bigint, content2_id bigint")
    few = {r["id"]: tuple(r) for r in dup.profiles(df, "doc_id", "text", (), pairs).collect()}
    every = {r["id"]: tuple(r) for r in dup.profiles(df, "doc_id", "text").collect()}
    assert set(few) == {1, 4, 7} and len(every) == 12 and all(every[i] == x for i, x in few.items())
