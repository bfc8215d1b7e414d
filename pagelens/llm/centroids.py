"""Exact k-means over integer vectors, with centroids filtered by n-simplex projection.

A few pivots are drawn from the vectors. Their mutual distances make a simplex; the distances of any vector to them make
it the apex of that simplex, with one coordinate for each pivot, the last being its height over the base. Distances to the
pivots are taken once and the apexes are kept beside the vectors. For two apexes the Euclidean distance is a lower bound of
the true one, and the distance to the other's mirror image below the base an upper bound. In a round a vector is compared,
in exact integers, only with the centroids whose lower bound does not exceed the least upper bound; where a single one is
left, only the reported distance is computed. Bounds are floating point, so they are widened by SLACK of the distances
they come from; comparisons that decide are integer.

A round sends `k` centroids out and brings back, for each cluster and component, an exact sum: what goes through the driver
is fixed by k and the number of components. Sums are cut into limbs of LIMB bits, so neither a sum nor a
component can overflow. Vectors and apexes are read from a table in the shared folder, so lost tasks are repeated.

Results for odd input: vectors that are null, of another size, or hold a null, a NaN or an infinity are left out; a null key is
clustered but never a first centroid; repeated rows count once each; ties go to the smaller centroid number, equal keys are
ordered by their components; with fewer vectors than k there are fewer centroids; an empty table gives an empty result; a
distance or a sum beyond 63 bits is null; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.llm.shipping import map_arrow
from pagelens.session import scratch_path

SCALE = 1024
PIVOTS = 16
#: Integers below this have squared distances of up to 2^10 components in 63 bits.
SMALL = 1 << 25
LIMB = 40
#: Share of the distances involved by which bounds are widened; their rounding error is below 1e-6 of them.
SLACK = 1e-5
#: Least squared height of a pivot over the earlier ones, as a share of its squared distance; flatter ones are left out.
LEAST_HEIGHT = 1e-2
CHUNK = 1 << 13


def kept(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(key, vector as array<double>) of the vectors of `size` finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    values = F.col(vector)
    ok = values.isNotNull() & (F.size(values) == size) & F.forall(values, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False)))
    return df.filter(ok).select(F.col(key).alias("key"), values.alias("v"))


def to_integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), exact at any magnitude: int64 if all are small, Python integers otherwise. `scale` is a power of two."""
    values = values.astype(np.float64)
    if not values.size or np.abs(values).max() * scale < SMALL:
        return np.floor(values * scale).astype(np.int64)
    exact = [int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in values.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of `a` to one vector `b`."""
    if a.dtype != object and b.dtype == object:
        a = a.astype(object)
    d = a - b
    return (d * d).sum(axis=1) if d.size or d.dtype != object else np.zeros(len(d), dtype=object)


def as_floats(values: np.ndarray) -> np.ndarray:
    """Floating point; integers beyond it are infinite."""
    if values.dtype != object:
        return values.astype(np.float64)
    return np.array([float(x) if x < 1 << 1023 else np.inf for x in values.tolist()])


@dataclass
class Simplex:
    """The base simplex: pivots, their distances to the first, and the triangle that turns distances into coordinates."""

    pivots: np.ndarray
    base: np.ndarray  # squared distances of the other pivots to the first
    triangle: np.ndarray  # inverse of the Cholesky factor of their Gram matrix

    @classmethod
    def of(cls, points: np.ndarray) -> Simplex:
        """From the first point on, the points that stand clearly above the span of those chosen before."""
        chosen = [0]
        for i in range(1, len(points)):
            trial = cls._built(points[[*chosen, i]])
            if trial is not None:
                chosen.append(i)
        return cls._built(points[chosen])

    @classmethod
    def _built(cls, points: np.ndarray) -> Simplex | None:
        d = np.array([as_floats(squared(points, p)) for p in points])
        base = d[0, 1:]
        if not np.isfinite(d).all():
            return cls(points, base, np.zeros((0, 0))) if len(points) == 1 else None
        gram = (base[:, None] + base[None, :] - d[1:, 1:]) / 2
        if not len(base):
            return cls(points, base, np.zeros((0, 0)))
        try:
            factor = np.linalg.cholesky(gram)
        except np.linalg.LinAlgError:
            return None
        if not (np.diag(factor) ** 2 >= LEAST_HEIGHT * base).all() or not (base > 0).all():
            return None
        return cls(points, base, np.linalg.inv(factor))

    def apex(self, vectors: np.ndarray) -> np.ndarray:
        """One row a vector: its coordinates in the base, its height, and its squared distance to the first pivot."""
        d = np.stack([as_floats(squared(vectors, p)) for p in self.pivots], axis=1)
        with np.errstate(invalid="ignore", over="ignore"):
            flat = ((d[:, :1] + self.base - d[:, 1:]) / 2) @ self.triangle.T
            height = np.sqrt(np.maximum(d[:, 0] - (flat**2).sum(axis=1), 0))
        return np.column_stack([flat, height, d[:, 0]])


def candidates(apexes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Boolean (vector, centroid): those that the bounds do not rule out as the nearest."""
    h, c = apexes[:, None, -2], centres[None, :, -2]
    with np.errstate(invalid="ignore", over="ignore"):
        flat = ((apexes[:, None, :-2] - centres[None, :, :-2]) ** 2).sum(axis=2)
        slack = SLACK * (apexes[:, None, -1] + centres[None, :, -1]) + 1
        lower, upper = flat + (h - c) ** 2 - slack, flat + (h + c) ** 2 + slack
        # Bounds that are not numbers, from distances beyond a double, rule nothing out.
        return ~(lower > upper.min(axis=1, keepdims=True))


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centres: np.ndarray, distances: bool) -> tuple:
    """(cluster, squared distance or None, candidates left by the bounds) of each vector; ties go to the smaller number."""
    may = candidates(apexes, centres)
    left = may.sum(axis=1)
    label = may.argmax(axis=1)
    best = np.zeros(len(vectors), dtype=vectors.dtype if centroids.dtype != object else object)
    open_ = np.flatnonzero((left > 1) | distances)
    set_ = np.zeros(len(vectors), dtype=bool)
    for c in range(len(centroids)):
        rows = open_[may[open_, c]]
        if not len(rows):
            continue
        d = squared(vectors[rows], centroids[c])
        closer = ~set_[rows] | (d < best[rows])
        best[rows[closer]], label[rows[closer]] = d[closer], c
        set_[rows] = True
    return label, best if distances else None, left


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _chunks(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            yield batch.slice(at, CHUNK)


def _apexes(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("apex").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def with_apexes(vectors: DataFrame, simplex: Simplex, scale: int) -> DataFrame:
    """The vectors and their apexes, written to the shared folder."""
    spark = vectors.sparkSession
    schema = T.StructType([*vectors.schema.fields, T.StructField("apex", T.ArrayType(T.DoubleType()))])
    sent = spark.sparkContext.broadcast(simplex)

    def run(batches):
        for batch in _chunks(batches):
            apex = sent.value.apex(to_integers(_vectors(batch), scale))
            offsets = np.arange(len(apex) + 1, dtype=np.int32) * apex.shape[1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(apex.ravel()))], names=[*batch.schema.names, "apex"]
            )

    path = scratch_path(spark, "apexes")
    map_arrow(vectors, run, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _limbs(value: int):
    """(nth, limb) rows whose limbs times 2^(LIMB * nth) add up to the value."""
    sign, value, nth = (-1 if value < 0 else 1), abs(value), 0
    while value or not nth:
        yield nth, sign * (value & ((1 << LIMB) - 1))
        value, nth = value >> LIMB, nth + 1


def cluster_sums(table: DataFrame, centroids: np.ndarray, simplex: Simplex, scale: int) -> tuple[np.ndarray, list[int]]:
    """(exact sums of the vectors of each cluster, their counts): one round, brought back as rows of (cluster, component, limb)."""
    k, size = centroids.shape
    sent = table.sparkSession.sparkContext.broadcast((centroids, simplex.apex(centroids)))

    def run(batches):
        sums, counts = np.zeros((k, size), dtype=object), np.zeros(k, dtype=np.int64)
        centroids, centres = sent.value
        for batch in _chunks(batches):
            vectors = to_integers(_vectors(batch), scale)
            label = nearest(vectors, _apexes(batch), centroids, centres, distances=False)[0]
            for c in np.unique(label).tolist():
                sums[c] += vectors[label == c].sum(axis=0).astype(object)
            counts += np.bincount(label, minlength=k)
        rows = [
            (c, i, nth, limb, int(counts[c]) if nth == 0 else 0)
            for c in np.flatnonzero(counts).tolist() for i in range(size) for nth, limb in _limbs(int(sums[c, i]))
        ]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, names=list("cinlm"))

    out = map_arrow(table.select("v", "apex"), run, "c bigint, i bigint, n bigint, l bigint, m bigint")
    wide = out.groupBy("c", "i", "n").agg(F.sum(F.col("l").cast("decimal(38,0)")).alias("l"), F.sum("m").alias("m"))
    sums, counts = np.zeros((k, size), dtype=object), [0] * k
    # At most k times components times a few limbs, whatever the number of vectors.
    for r in wide.collect():
        sums[r.c, r.i] += int(r.l) << (LIMB * r.n)
        if r.n == 0 and r.i == 0:
            counts[r.c] = r.m
    return sums, counts


def _narrow(values: np.ndarray) -> np.ndarray:
    """int64 if the values are small."""
    return values.astype(np.int64) if all(abs(x) < SMALL for x in values.ravel().tolist()) else values.astype(object)


@dataclass
class Clustering:
    table: DataFrame  # key, v, apex
    centroids: np.ndarray
    simplex: Simplex | None
    scale: int


def fit(df: DataFrame, key: str, vector: str, size: int, k: int, rounds: int, order: Column, scale: int = SCALE, pivots: int = PIVOTS) -> Clustering:
    """k-means from the `k` vectors that come first by `order` (an expression over `key`; nulls never)."""
    vectors = kept(df, key, vector, size)
    first = (
        vectors.select(order.alias("o"), F.col("v").cast("array<double>").alias("v")).filter("o is not null").orderBy("o", "v").limit(max(k, pivots))
    ).collect()
    # With keys that are all null there is no centroid to begin with, and no result.
    if not first:
        return Clustering(vectors.withColumn("apex", F.array().cast("array<double>")).limit(0), np.zeros((0, size), np.int64), None, scale)
    points = _narrow(to_integers(np.array([r.v for r in first]), scale))
    simplex = Simplex.of(points)
    table = with_apexes(vectors, simplex, scale)
    centroids = points[:k]
    for _ in range(rounds):
        sums, counts = cluster_sums(table, centroids, simplex, scale)
        moved = _narrow(np.array([[s // n for s in row] if n else list(map(int, c)) for row, n, c in zip(sums, counts, centroids)], dtype=object))
        if (moved == centroids).all():
            break  # every later round would give the same
        centroids = moved
    return Clustering(table, centroids, simplex, scale)


def assign(found: Clustering) -> DataFrame:
    """(key, cluster, distance: squared, compared: centroids that the bounds left)."""
    if found.simplex is None:
        return found.table.select("key", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"), F.lit(0).alias("compared"))
    schema = T.StructType([found.table.schema["key"], *T._parse_datatype_string("cluster int, distance bigint, compared int").fields])
    sent = found.table.sparkSession.sparkContext.broadcast((found.centroids, found.simplex.apex(found.centroids), found.scale))

    def run(batches):
        centroids, centres, scale = sent.value
        for batch in _chunks(batches):
            label, best, left = nearest(to_integers(_vectors(batch), scale), _apexes(batch), centroids, centres, distances=True)
            distance = [x if x < 1 << 63 else None for x in best.tolist()] if best.dtype == object else best
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(label.astype(np.int32)), pa.array(distance, pa.int64()), pa.array(left.astype(np.int32))],
                names=["key", "cluster", "distance", "compared"],
            )

    return map_arrow(found.table, run, schema)


def cluster(df: DataFrame, key: str, vector: str, size: int, k: int, rounds: int, order: Column, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """(key, cluster, distance, compared, cluster_inertia, inertia, centroid: its components, centroid_sha256) of each vector kept."""
    spark = df.sparkSession
    found = fit(df, key, vector, size, k, rounds, order, scale, pivots)
    path = scratch_path(spark, "assigned")
    labelled = assign(found)
    labelled.write.parquet(path)
    rows = spark.read.schema(labelled.schema).parquet(path)
    beyond = F.count_if(F.col("distance").isNull())
    total = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), beyond.alias("beyond")).collect()
    # One row a cluster.
    sums = {r.cluster: None if r.beyond or r.d is None else int(r.d) for r in total}
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    whole = fits(None if None in sums.values() else sum(sums.values()))
    about = [
        (c, fits(s), whole, [str(x) for x in found.centroids[c].tolist()], hashlib.sha256(",".join(map(str, found.centroids[c].tolist())).encode()).hexdigest())
        for c, s in sorted(sums.items())
    ]
    named = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<string>, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").withColumnRenamed("key", key)
