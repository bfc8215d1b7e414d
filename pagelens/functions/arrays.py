"""Per-row counting over arrays, without leaving the row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(col: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `col` once per row and use it many times in `body`.

    A column named once inside a lambda is not safe from being merged into it,
    where it would be evaluated for every element; a bound value is.
    """
    return F.get(F.transform(F.array(col), body), F.lit(0))


def add_run_counts(df: DataFrame, items: str, out: str) -> DataFrame:
    """Add `out`: array of (word, n, first_pos), one entry per distinct item of `items`.

    Sort once, keep run starts, subtract neighbouring starts. This is
    O(n log n) in the row and needs no shuffle, where explode + groupBy would
    send every (row, item) pair over the network. Each step is its own column,
    because a lambda would otherwise evaluate it again for every element.
    """
    s, b = f"__sorted_{out}", f"__starts_{out}"
    df = df.withColumn(
        s,
        F.sort_array(
            F.transform(items, lambda w, i: F.struct(w.alias("word"), (i + F.lit(1)).cast("int").alias("pos")))
        ),
    )
    df = df.withColumn(
        b,
        F.filter(
            F.transform(
                s,
                lambda x, i: F.when(
                    (i == 0) | (x["word"] != F.get(F.col(s), F.greatest(i - 1, F.lit(0)))["word"]), i
                ).otherwise(F.lit(-1)),
            ),
            lambda i: i >= 0,
        ),
    )
    return df.withColumn(
        out,
        F.transform(
            b,
            lambda start, k: F.struct(
                F.get(F.col(s), start)["word"].alias("word"),
                (F.coalesce(F.get(F.col(b), k + 1), F.size(F.col(s))) - start).cast("bigint").alias("n"),
                F.get(F.col(s), start)["pos"].cast("bigint").alias("first_pos"),
            ),
        ),
    ).drop(s, b)


def add_top_counts(df: DataFrame, runs: str, out: str, k: int, ties: str) -> DataFrame:
    """Add `out`: the `k` most frequent entries of a run-count column.

    `ties` names the entry field that decides equal counts, ascending.
    """
    ranked = F.sort_array(
        F.transform(
            runs,
            lambda r: F.struct((-r["n"]).alias("neg"), r[ties].alias("tie"), r.alias("run")),
        )
    )
    return df.withColumn(out, F.transform(F.slice(ranked, 1, k), lambda x: x["run"]))


def add_top_items(df: DataFrame, items: str, out: str, k: int) -> DataFrame:
    """Add `out`: the `k` most frequent distinct strings of `items`, best first, equal counts by name.

    As `add_top_counts`, but plain strings and plain numbers are sorted, which costs a fraction of sorting structs:
    a run's place among all runs is its rank by name, so count and place make one number.
    """
    s, b = f"__sorted_{out}", f"__starts_{out}"
    df = df.withColumn(s, F.sort_array(items))
    start_of = lambda x, i: F.when((i == 0) | (x != F.get(F.col(s), F.greatest(i - 1, F.lit(0)))), i).otherwise(F.lit(-1))
    df = df.withColumn(b, F.filter(F.transform(s, start_of), lambda i: i >= 0))
    span = F.lit(1 << 32)
    ranked = F.sort_array(
        F.transform(b, lambda start, j: (start - F.coalesce(F.get(F.col(b), j + 1), F.size(F.col(s)))).cast("bigint") * span + j)
    )
    best = F.transform(F.slice(ranked, 1, k), lambda x: F.get(F.col(s), F.get(F.col(b), F.pmod(x, span).cast("int"))))
    return df.withColumn(out, best).drop(s, b)
