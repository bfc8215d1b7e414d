"""A layered classifier over sparse rows, with the objective and search of MLlib's perceptron.

MLlib's trainer keeps every row as a dense vector: with 5,000 terms that is 40 KB, whatever the text holds. Here a block of
rows is dense only while a task works on it, and only in the terms it holds; what is read again is the sparse table. Tasks
return the sums of their blocks, which are added up in a tree, so the driver holds the weights and the search's last steps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a block, as in MLlib; the objective is the mean of the blocks' means.
BLOCK = 128
#: Steps that the search remembers, its tolerance, and the bounds of its line search (sufficient decrease, curvature).
MEMORY, TOLERANCE = 10, 1e-6
DECREASE, CURVATURE, TRIES = 1e-4, 0.9, 10


def as_model(spark: SparkSession, sizes: Sequence[int], weights: np.ndarray | None = None, seed: int = 42) -> MultilayerPerceptronClassificationModel:
    """MLlib's model of these weights, or of those it starts from."""
    # No step is taken, so the one row only names the columns.
    row = spark.createDataFrame([(Vectors.sparse(sizes[0], [], []), 0.0)], ["features", "label_index"])
    step = MultilayerPerceptronClassifier(layers=list(sizes), seed=seed, maxIter=0, labelCol="label_index", featuresCol="features")
    if weights is None:
        return step.fit(row)
    model = step.setInitialWeights(Vectors.dense(weights)).fit(row)
    model.clear(model.initialWeights)  # else it is saved with each model once more
    return model


def objective(rows: DataFrame, sizes: Sequence[int], block: int = BLOCK) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The loss and its gradient at given weights, over written `rows` (features: sparse vectors, label_index)."""
    spark, sizes = rows.sparkSession, list(sizes)
    sparse = F.unwrap_udt("features")
    slim = rows.select(sparse["indices"].alias("i"), sparse["values"].alias("x"), F.col("label_index").cast("int").alias("y"))
    # Each task returns a gradient as large as the weights: as many as there are cores, however large the input.
    slim = slim.coalesce(spark.sparkContext.defaultParallelism)

    def at(weights: np.ndarray) -> tuple[float, np.ndarray]:
        sent = spark.sparkContext.broadcast(weights)

        def run(batches):
            def layers(flat):
                """(in x out weights, out weights) of each layer, as views."""
                begin, out = 0, []
                for n, m in zip(sizes, sizes[1:]):
                    out.append((flat[begin : begin + n * m].reshape(n, m), flat[begin + n * m : begin + (n + 1) * m]))
                    begin += (n + 1) * m
                return out

            def blocks():
                rest = None
                for batch in batches:
                    rest = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
                    full = rest.num_rows // block * block
                    yield from (rest.slice(a, block) for a in range(0, full, block))
                    rest = rest.slice(full) if full < rest.num_rows else None
                if rest is not None:
                    yield rest

            model, total = layers(sent.value), np.zeros(len(sent.value))
            sums, loss, n_blocks = layers(total), 0.0, 0
            for part in blocks():
                n = part.num_rows
                used, place = np.unique(part.column("i").flatten().to_numpy(), return_inverse=True)
                dense = np.zeros((n, len(used)))
                dense[np.repeat(np.arange(n), part.column("i").value_lengths().to_numpy()), place] = part.column("x").flatten().to_numpy()
                values = [dense]
                for k, (w, b) in enumerate(model):
                    z = values[-1] @ (w if k else w[used]) + b
                    if k < len(model) - 1:
                        with np.errstate(over="ignore"):
                            values.append(1.0 / (1.0 + np.exp(-z)))
                    else:
                        z = np.exp(z - z.max(axis=1, keepdims=True))
                        values.append(z / z.sum(axis=1, keepdims=True))
                delta, known = values[-1], (np.arange(n), part.column("y").to_numpy())
                with np.errstate(divide="ignore"):
                    loss -= np.log(delta[known]).sum() / n
                delta[known] -= 1.0
                for k in range(len(model) - 1, -1, -1):
                    sums[k][1][:] += delta.sum(axis=0) / n
                    own = values[k].T @ delta / n
                    if k:
                        sums[k][0][:] += own
                        delta = delta @ model[k][0].T * values[k] * (1.0 - values[k])
                    else:
                        sums[0][0][used] += own
                n_blocks += 1
            if n_blocks:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([loss]), pa.array([n_blocks]), pa.array([total.tobytes()], pa.binary())], ["loss", "blocks", "gradient"]
                )

        parts = slim.mapInArrow(run, "loss double, blocks bigint, gradient binary").rdd.map(lambda r: (r[0], r[1], np.frombuffer(r[2])))
        loss, n, gradient = parts.treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2]))
        sent.destroy()
        return loss / n, gradient / n

    return at


class NoStep(ValueError):
    """The search found no step along its direction."""


def _direction(grad: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Limited-memory BFGS: the negative gradient, scaled by the steps and changes of the gradient in `past` (last first)."""
    out, scales = grad.copy(), []
    if past and not past[0][0] @ past[0][1] >= 0:
        raise NoStep("curvature")
    for step, change in past:
        rho = step @ change
        scales.append((step @ out / rho, rho))
        if np.isnan(scales[-1][0]):
            raise NoStep("history")
        out -= scales[-1][0] * change
    if past:
        step, change = past[0]
        out *= (step @ change) / (change @ change)
    for (step, change), (a, rho) in zip(reversed(past), reversed(scales)):
        out += (a - change @ out / rho) * step
    return -out


def _between(left: tuple, right: tuple) -> float:
    """The minimum of the cubic through both ends (place, value, slope), not within a tenth of either."""
    (a, fa, da), (b, fb, db) = left[:3], right[:3]
    d1 = da + db - 3 * (fa - fb) / (a - b)
    d2 = np.sqrt(d1 * d1 - da * db)
    t = b - (b - a) * (db + d2 - d1) / (db - da + 2 * d2)
    low, high = a + 0.1 * (b - a), a + 0.9 * (b - a)
    return low if t < low else high if t > high else t


def _searched(along: Callable[[float], tuple], start: tuple, t: float) -> tuple:
    """The first point (place, value, slope, ...) found that meets the strong Wolfe conditions."""
    _, value, slope = start[:3]
    if slope > 0:
        raise NoStep("not a descent")

    def zoom(low: tuple, high: tuple) -> tuple:
        for _ in range(TRIES):
            c = along(_between(high, low) if low[0] > high[0] else _between(low, high))
            if c[1] > value + DECREASE * c[0] * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= CURVATURE * abs(slope):
                return c
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise NoStep("zoom")

    low = start
    for i in range(TRIES):
        c = along(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + DECREASE * t * slope or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= CURVATURE * abs(slope):
            return c
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise NoStep("search")


def minimised(
    f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, seen: list[np.ndarray] | None = None
) -> tuple[np.ndarray, list[float]]:
    """(the weights after at most `steps` steps of limited-memory BFGS, the loss before and after each); `seen` gets the weights after each."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    losses, recent, failed = [value], [np.inf], False
    while len(losses) <= steps and np.linalg.norm(grad) > max(TOLERANCE * value, 1e-8):
        if len(recent) > 1 and abs(value - max(recent)) <= TOLERANCE * losses[0]:
            break
        try:
            way = _direction(grad, past)

            def along(t: float, x=x, way=way) -> tuple:
                v, g = f(x + t * way)
                return t, v, g @ way, g

            found = _searched(along, (0.0, value, grad @ way, grad), 1.0 if len(losses) > 1 else 1.0 / np.linalg.norm(way))
            if found[0] * np.linalg.norm(grad) < 1e-10:
                raise NoStep("too short")
        except NoStep:
            # Once more without the memory of earlier steps.
            if failed:
                break
            failed, past = True, []
            continue
        failed = False
        new = x + found[0] * way
        past = [(new - x, found[3] - grad), *past][:MEMORY]
        x, value, grad = new, found[1], found[3]
        losses.append(value)
        if seen is not None:
            seen.append(x)
        recent = [*recent, value][-20:]
    return x, losses


def train_network(
    rows: DataFrame, sizes: Sequence[int], steps: int, weights: np.ndarray | None = None, seed: int = 42, seen: list[np.ndarray] | None = None
) -> tuple[np.ndarray, list[float]]:
    """(weights, losses: before and after each step) of a network of layer `sizes` over written `rows` (features, label_index)."""
    if weights is None:
        weights = as_model(rows.sparkSession, sizes, seed=seed).weights.toArray()
    return minimised(objective(rows, sizes), weights, steps, seen)
