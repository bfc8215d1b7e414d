"""Periodic runs of words by seed and extend on diagonals.

A run is a stretch of consecutive words with smallest period q, of at least `least_length` words and `least_power` * q, that
no neighbouring word extends. On the diagonal of lag q (word i against word i + q) it is a stretch of matches of at least
(least_power - 1) * q words. So for the lags of [2^j, 2^(j+1)) the k-grams of k = 3 * 2^j words, which no such stretch is
shorter than, are indexed per document. Such a gram is longer than any lag of its class, and inside a run whose word is no
power of a shorter one it can only return after q words: looking at neighbours in a gram's list of positions finds a seed of
every run, and no list is ever paired with itself. Grams are numbered exactly (by sorting pairs of the numbers of their
halves, no hashes), and a gram whose half occurs once cannot repeat, so ordinary prose leaves the index after the first step.

A seed is extended to both sides by blocks that double. Each lag keeps how far it has been covered; seeds before that are
skipped, so a stretch is extended once. By the choice of k the stretches of a class overlap little: the work is n log n at worst.

Texts stay in their partition: no shuffle. A slice of a few megabytes of texts is indexed at once.

Results for odd input: null, empty and wordless texts have no run, and collapse to an empty text; very long texts are indexed
whole, a slice of their own; repeated rows have a row each; ties for the top run go to the smallest start, then the smallest
period; an empty table gives an empty result; other columns travel in the struct `row`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagelens.llm.shipping import map_arrow
from pagelens.llm.words import PLAIN, Words, slices, split_words, string_array, texts_of

LEAST_LENGTH = 6
LEAST_POWER = 4
#: Words of the grams of lag 1; those of the lags from 2^j are 2^j times as long.
GRAM = 3
SLICE_BYTES = 2 << 20
FIRST_BLOCK = 32


def _grouped(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, group) of the keys that occur twice or more, sorted by group and then position; `at` ascends."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    same = sorted_key[1:] == sorted_key[:-1]
    again = np.zeros(len(key), dtype=bool)
    again[1:] |= same
    again[:-1] |= same
    group = np.cumsum(np.concatenate([[0], ~same])) if len(key) else np.zeros(0, dtype=np.int64)
    return at[order][again], group[again]


def document_words(words: Words) -> np.ndarray:
    """A number for each word, equal for equal words of the same text only."""
    coded = words.strings().dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(words.docs) - 1), np.diff(words.docs))
    _, number = np.unique(text * max(len(coded.dictionary), 1) + code, return_inverse=True)
    return number


def gram_classes(number: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(least lag, k, positions, group) of the repeated k-grams of each class of lags, sorted by group and position."""
    n = len(number)
    count = np.bincount(number) if n else np.zeros(1, dtype=np.int64)
    often = count[number] > 1
    at = np.flatnonzero(often[:-2] & often[1:-1] & often[2:]) if n > 2 else np.zeros(0, dtype=np.int64)
    pairs, group = _grouped(at, number[at] * (n + 1) + number[at + 1])
    at = np.sort(pairs)
    half = np.zeros(n, dtype=np.int64)
    half[pairs] = group
    at, group = _grouped(at, half[at] * (n + 1) + number[at + 2])
    lag, k = 1, GRAM
    while len(at):
        yield lag, k, at, group
        rank = np.full(n + k, -1, dtype=np.int64)
        rank[at] = group
        at = np.sort(at)
        at = at[rank[at + k] >= 0]
        at, group = _grouped(at, rank[at] * (n + 1) + rank[at + k])
        lag, k = 2 * lag, 2 * k


def _matches(number: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from `at` on, in direction `step`, equal the word `lag` later."""
    n, block, found = len(number), FIRST_BLOCK, 0
    while True:
        room = min(block, n - lag - at if step > 0 else at + 1)
        if room <= 0:
            return found
        low = at if step > 0 else at - room + 1
        differ = np.flatnonzero(number[low : low + room] != number[low + lag : low + lag + room])
        if len(differ):
            return found + int(differ[0] if step > 0 else room - 1 - differ[-1])
        at, found, block = at + step * room, found + room, 2 * block


def find_runs(number: np.ndarray, least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and then period; `least_power` is 4 or more."""
    if least_power < 4 or least_length < 4:
        raise ValueError("runs are found from a power of 4 and a length of 4 on")
    runs = []
    for least_lag, k, at, group in gram_classes(number):
        lags = np.diff(at)
        seed = (group[1:] == group[:-1]) & (lags >= least_lag) & (lags < 2 * least_lag)
        seeds, lags = at[:-1][seed], lags[seed]
        order = np.lexsort((seeds, lags))
        seeds, lags = seeds[order], lags[order]
        edges = np.flatnonzero(np.diff(lags)) + 1
        for own in np.split(np.arange(len(seeds)), edges):
            if not len(own):
                continue
            lag, places = int(lags[own[0]]), seeds[own]
            covered, nth = -1, 0
            while nth < len(places):
                i = int(places[nth])
                begin = i - _matches(number, i - 1, lag, -1)
                covered = i + k + _matches(number, i + k, lag, 1)
                length = covered + lag - begin
                if length >= max(least_length, least_power * lag):
                    runs.append((begin, length, lag))
                # A seed that begins before `covered` lies on the same stretch, as it matches there.
                nth = int(np.searchsorted(places, covered))
    return sorted(runs, key=lambda r: (r[0], r[2]))


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def with_runs(df: DataFrame, text: str, least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER) -> DataFrame:
    """(row, n_words, runs, top: the run of greatest length / period, collapsed: the words that are in no run's later rounds)."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    schema = T.StructType(
        packed.schema.fields + T._parse_datatype_string(f"n_words bigint, runs array<{RUN}>, top {RUN}, collapsed string").fields
    )
    arrow = to_arrow_schema(schema)
    run_type = arrow.field("top").type

    def run(batches):
        for part in slices(batches, f"row.{text}", SLICE_BYTES):
            words = split_words(texts_of(part, f"row.{text}"), PLAIN)
            runs = find_runs(document_words(words), least_length, least_power)
            n_texts = part.num_rows
            keep = np.ones(len(words.starts) + 1, dtype=np.int64)
            own: list[list[dict]] = [[] for _ in range(n_texts)]
            top: list[dict | None] = [None] * n_texts
            starts = np.array([r[0] for r in runs], dtype=np.int64)
            owner = np.searchsorted(words.docs, starts, side="right") - 1
            change = np.zeros(len(words.starts) + 1, dtype=np.int64)
            for (start, length, period), text_number in zip(runs, owner.tolist()):
                change[start + period] += 1
                change[start + length] -= 1
                one = {"start": start - int(words.docs[text_number]), "length": length, "period": period}
                own[text_number].append(one)
                best = top[text_number]
                if best is None or length * best["period"] > best["length"] * period:
                    top[text_number] = one
            keep = np.cumsum(change)[:-1] == 0
            # One blank stands after each word; the last kept one of a text goes.
            kept_bytes = np.repeat(keep, words.lengths + 1)
            sizes = np.concatenate([[0], np.cumsum(np.where(keep, words.lengths + 1, 0))])[words.docs]
            data, ends = words.joined[kept_bytes], sizes[1:]
            filled = np.diff(sizes) > 0
            inner = np.ones(len(data), dtype=bool)
            inner[ends[filled] - 1] = False
            offsets = sizes - np.concatenate([[0], np.cumsum(filled)])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"), pa.array(np.diff(words.docs)), pa.array(own, pa.list_(run_type)).cast(arrow.field("runs").type),
                    pa.array(top, run_type), string_array(data[inner], offsets).cast(arrow.field("collapsed").type),
                ],
                names=[f.name for f in arrow],
            )

    return map_arrow(packed, run, schema)
