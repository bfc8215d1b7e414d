"""k-means with filtered centroids against SQL and a plain version in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from pagelens.llm import centroids
from pagelens.llm.catalog import ENTRIES

SIZE = 6


def by_hash():
    return F.sha2(F.concat(F.lit("3:"), F.col("key").cast("string")), 256)


def plain(rows, k, rounds):
    """(key, cluster, distance) by comparing every vector with every centroid."""
    ok = [(i, v) for i, v in rows if v is not None and len(v) == SIZE and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [int(x) * 1024 if abs(x) >= 2**53 else math.floor(1024 * x) for x in v]) for i, v in ok]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in whole if i is not None)
    middle = [v for _, v in first[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(middle))

    for _ in range(rounds):
        own = [(near(v)[1], v) for _, v in whole]
        for c in range(len(middle)):
            mine = [v for n, v in own if n == c]
            if mine:
                middle[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, near(v)[1], near(v)[0]) for i, v in whole], middle


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, *[x or 0 for x in r]))


def check(spark, rows, k=4, rounds=5, kind="double", pivots=5):
    df = spark.createDataFrame(rows, f"vec_id bigint, e array<{kind}>").withColumns({c: F.lit(1) for c in ("v", "key", "cluster", "apex", "distance")})
    got = centroids.cluster(df.repartition(3), "vec_id", "e", SIZE, k, rounds, by_hash(), pivots=pivots).collect()
    wanted, middle = plain(rows, k, rounds)
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    assert order([(r.vec_id, r.cluster, r.distance) for r in got]) == order([(i, c, fits(d)) for i, c, d in wanted])
    for r in got:
        own = sum(d for _, c, d in wanted if c == r.cluster)
        assert r.cluster_inertia == fits(own) and r.inertia == fits(sum(d for *_, d in wanted))
        text = ",".join(map(str, middle[r.cluster]))
        assert ",".join(r.centroid) == text and r.centroid_sha256 == hashlib.sha256(text.encode()).hexdigest()
    return got


def test_op11_equals_sql(spark):
    query = {e.name: e for e in ENTRIES}["op11_centroids"]
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert compare(query, spark, connect(folder), folder) is None


def test_ties_copies_and_left_out_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5]) for _ in range(SIZE)]) for i in range(200)]
    rows += [(7, rows[7][1])] * 60 + [(None, rows[3][1])] * 3
    rows += [(900, None), (901, []), (902, [1.0] * (SIZE + 1)), (903, [None] + [1.0] * (SIZE - 1)), (904, [float("nan")] + [1.0] * (SIZE - 1)), (905, [float("inf")] * SIZE)]
    check(spark, rows)


def test_bounds_leave_few_centroids(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(3 * (i % 4 == c), 0.2) for c in range(SIZE)]) for i in range(400)]
    got = check(spark, rows, k=4, rounds=3)
    assert sum(r.compared for r in got) < 2 * len(got)


def test_components_beyond_64_bits(spark):
    rng = random.Random(7)
    rows = [(i, [rng.choice([1e300, -3e200, 1e17, 12.75, -0.001]) * rng.random() for _ in range(SIZE)]) for i in range(40)]
    got = check(spark, rows)
    assert any(r.distance is None for r in got)


def test_few_and_no_vectors(spark):
    check(spark, [(1, [1.0] * SIZE)] * 3)
    check(spark, [(1, [1.0] * SIZE), (2, [2.0] * SIZE)])
    for rows in ([], [(None, [1.0] * SIZE)]):
        df = spark.createDataFrame(rows, "vec_id bigint, e array<double>")
        assert centroids.cluster(df, "vec_id", "e", SIZE, 4, 2, by_hash()).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_bounds_hold(seed):
    rng = np.random.default_rng(seed)
    points = (rng.normal(size=(60, 12)) * [1000, 1000, 1000, 300, 300, 10, 10, 1, 0, 0, 0, 500]).astype(np.int64)
    simplex = centroids.Simplex.of(points[:9])
    apex = simplex.apex(points)
    may = centroids.candidates(apex, apex[:10])
    exact = np.stack([centroids.squared(points, c) for c in points[:10]], axis=1)
    assert all(may[i, exact[i].argmin()] for i in range(len(points)))
    low = ((apex[:, None, :-1] - apex[None, :10, :-1]) ** 2).sum(axis=2)
    assert (low <= exact * (1 + 1e-9) + 1).all()
