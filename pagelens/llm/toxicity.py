"""Toxicity by compression distance: what does a text cost with an ordinary dictionary, and with a toxic one?

Training reads a bounded, documented sample of labelled texts (the first by a hash of key and text).
A zstandard dictionary is trained on windows of the ordinary texts and another on windows of the toxic ones.
The toxic one also learns ordinary prose, so it is pruned: of the word beginnings in it, those stay
that occur in clearly more toxic than ordinary texts. The ordinary dictionary is extended by the ordinary words
that come nearest to those segments. Both classifiers share the ordinary part, at the same distance, so on
ordinary text they cost the same to the byte, and a window that the toxic segments shorten stands out.

Scoring cuts a text into windows of a few words, at several scales, and takes for each the difference
between its two compressed lengths. A window without four bytes in common with a toxic segment cannot be
shortened by it (zstandard matches four bytes or more here), so its difference is 0 without compressing.
The largest differences of a text at the scales are added and become a probability by the labels of the calibration sample: the share
of toxic texts at each sum, made monotone by pooling neighbours.

Only the text is looked at. Results for odd input: null, empty and wordless texts have no window and get the
probability of difference 0; repeated rows are scored each; labels that are null are left out; without toxic or
without ordinary labels every text gets the share of toxic labels, or 0; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.llm.shipping import map_arrow, trim
from pagelens.llm.words import ALPHANUMERIC, slices, split_words, texts_of

#: Labelled texts of each class that training and calibration read at most; each of them whole.
SAMPLE = 1500
WINDOW_WORDS = (5, 8, 13)
TRAIN_WINDOW = 16
LEVEL = 6
SLICE_BYTES = 4 << 20
TRAIN_BYTES = 1 << 19
ORDINARY_BYTES = 8 << 10
NEAR_BYTES = 20_000
TOXIC_BYTES = 64 << 10
#: Bytes of word beginnings that may become toxic segments.
STEM = (4, 12)
#: Least z score of a toxic segment, alone and as a share of the best segment's.
LEAST_Z, SHARE_Z = 4.0, 1 / 3
MOST_DIFFERENCE = 24


@dataclass
class Model:
    """A few tens of kilobytes whatever the corpus."""

    ordinary: bytes = b""
    toxic: bytes = b""  # the toxic segments, each after a blank
    chance: list[float] = field(default_factory=lambda: [0.0])  # probability by largest difference
    _tools: tuple | None = None

    def grams(self) -> set[bytes]:
        return {self.toxic[i : i + 4] for i in range(max(len(self.toxic) - 3, 0))}

    def tools(self):
        if self._tools is None:
            import zstandard

            def compressor(content: bytes):
                own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(level=LEVEL)
                return zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False
                ).compress

            self._tools = compressor(self.ordinary), compressor(self.toxic + self.ordinary)
        return self._tools

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic, "chance": self.chance, "_tools": None}

    def differences(self, texts: pa.Array) -> np.ndarray:
        """Each text's largest difference of each scale, added up: 0 to MOST_DIFFERENCE.

        A toxic word shortens a window of every scale, a chance match rarely more than one.
        """
        words = split_words(texts, ALPHANUMERIC)
        n_texts = len(words.docs) - 1
        most = np.zeros(n_texts, dtype=np.int64)
        if not self.toxic or not len(words.starts):
            return most
        ordinary, toxic = self.tools()
        coded = words.strings().dictionary_encode()
        pattern = re.compile(b"|".join(re.escape(g) for g in sorted(self.grams())))
        may = np.array([pattern.search(b" %b " % w.encode()) is not None for w in coded.dictionary.to_pylist()], dtype=bool)
        may = may[coded.indices.to_numpy()]
        owner = np.repeat(np.arange(n_texts), np.diff(words.docs))
        candidates = np.flatnonzero(may)
        ends = words.starts + words.lengths
        raw = words.joined.tobytes()
        for scale in WINDOW_WORDS:
            text = owner[candidates]
            first = words.docs[text]
            begin = np.unique(first + (candidates - first) // scale * scale)
            text, own = owner[begin], np.zeros(n_texts, dtype=np.int64)
            last = np.minimum(begin + scale, words.docs[text + 1]) - 1
            for t, a, b in zip(text.tolist(), words.starts[begin].tolist(), ends[last].tolist()):
                window = b" %b " % raw[a:b]
                d = len(ordinary(window)) - len(toxic(window))
                if d > own[t]:
                    own[t] = d
            most += own
        return np.minimum(most, MOST_DIFFERENCE)


def _sample(
    df: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str, sample: int
) -> tuple[list[tuple[str, int]], list[int]]:
    """(text, label) of at most `sample` labelled texts of each class, by a hash, and the counts of all labels."""
    marks = labels.filter(F.col(label).isin(0, 1) & F.col(label_key).isNotNull()).select(
        F.col(label_key).alias("key"), F.col(label).cast("int").alias("y")
    )
    # Labels are chosen before any text is read, so a bounded number of keys is broadcast and no text is shuffled.
    order = F.xxhash64("key", "y")
    chosen = [marks.filter(F.col("y") == y).distinct().orderBy(order, "key").limit(sample) for y in (0, 1)]
    both = df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(
        F.broadcast(chosen[0].union(chosen[1])), "key"
    )
    read = both.filter(F.col("text").isNotNull()).select("text", "y").limit(4 * sample).toArrow()
    rows = sorted(zip(read["text"].to_pylist(), read["y"].to_pylist()))
    found = dict(marks.groupBy("y").count().collect())
    return rows, [found.get(0, 0), found.get(1, 0)]


def _pieces(texts: list[str]) -> Iterator[pa.Array]:
    """The texts in order, in pieces that the driver can work on: their tables take several times the text."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    for part in slices(iter([batch]), "text", TRAIN_BYTES):
        yield part.column("text")


def _bytes_words(texts: list[str]) -> list[list[bytes]]:
    """The words of each text; equal words are one object."""
    out: list[list[bytes]] = []
    known: dict[bytes, bytes] = {}
    for part in _pieces(texts):
        words = split_words(part, ALPHANUMERIC)
        flat = [known.setdefault(w, w) for w in words.joined.tobytes().split()]
        out += [flat[a:b] for a, b in zip(words.docs[:-1].tolist(), words.docs[1:].tolist())]
    return out


def _windows(texts: list[list[bytes]]) -> list[bytes]:
    return [b" %b " % b" ".join(w[i : i + TRAIN_WINDOW]) for w in texts for i in range(0, len(w), TRAIN_WINDOW)]


def _trained(windows: list[bytes], size: int, segment: int) -> bytes:
    """Content of a trained dictionary; the windows themselves where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, windows, k=segment, d=8 if segment >= 32 else 6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(windows)[-size:]


def _beginnings(word: bytes):
    return (word[:n] for n in range(STEM[0], min(len(word), STEM[1]) + 1))


def _segments(trained: bytes, toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Word beginnings in the trained toxic dictionary that tell toxic from ordinary texts, best first."""
    wanted = {b for w in set(trained.split()) for b in _beginnings(w)}

    def seen_in(texts: list[list[bytes]]) -> tuple[Counter, dict[bytes, set[bytes]]]:
        """Texts with each beginning, and the words before it."""
        out: Counter = Counter()
        before: dict[bytes, set[bytes]] = {}
        for words in texts:
            own = set()
            for last, w in zip([b"", *words], words):
                for s in _beginnings(w):
                    if s in wanted:
                        own.add(s)
                        before.setdefault(s, set()).add(last)
            out.update(own)
        return out, before

    # Copied passages repeat a word in one context only, so contexts bound the number of texts that count.
    a, before = seen_in(toxic)
    a = Counter({s: min(n, len(before[s])) for s, n in a.items()})
    b, na, nb = seen_in(ordinary)[0], len(toxic), len(ordinary)

    def z(s: bytes) -> float:
        share = (a[s] + b[s]) / (na + nb)
        return (a[s] / na - b[s] / nb) / np.sqrt(max(share * (1 - share), 1e-9) * (1 / na + 1 / nb)) if a[s] else 0.0

    scores = {s: z(s) for s in wanted}
    best = max(scores.values(), default=0.0)
    good = [s for s, v in scores.items() if v >= max(LEAST_Z, best * SHARE_Z) and a[s] / na > 5 * b[s] / nb]
    stems: list[bytes] = []
    for s in sorted(good, key=lambda s: (-round(scores[s], 1), len(s), s)):
        if not any(s.startswith(t) or t.startswith(s) for t in stems):
            stems.append(s)
    # The longest form of a stem that still has most of its texts shortens a window most.
    return [max((c for c in wanted if c.startswith(s) and a[c] >= 0.8 * a[s]), key=lambda c: (len(c), c)) for s in stems]


def _pooled(values: list[int], labels: list[int], totals: list[int]) -> list[float]:
    """P(toxic) by difference, not falling: neighbours that would fall are pooled (isotonic regression).

    Sampled texts stand for all labels of their class.
    """
    weight = [totals[y] / max(labels.count(y), 1) for y in (0, 1)]
    blocks: list[list[float]] = []
    for d in range(MOST_DIFFERENCE + 1):
        own = [y for v, y in zip(values, labels) if v == d]
        blocks.append([sum(own) * weight[1], sum(weight[y] for y in own), 1.0])
        while len(blocks) > 1 and (blocks[-1][1] == 0 or blocks[-2][1] == 0 or blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]):
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
    return [s / n if n else 0.0 for s, n, width in blocks for _ in range(int(width))]


def train(
    df: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str, sample: int = SAMPLE
) -> Model:
    """Dictionaries and calibration from the labelled rows given; callers leave out the rows to hold out."""
    rows, totals = _sample(df, key, text, labels, label_key, label, sample)
    toxic, ordinary = _bytes_words([t for t, y in rows if y]), _bytes_words([t for t, y in rows if not y])
    if not toxic or not ordinary:
        return Model(chance=[float(bool(toxic))] * (MOST_DIFFERENCE + 1))
    plain = _trained(_windows(ordinary), ORDINARY_BYTES, 64)
    segments = _segments(_trained(_windows(toxic), TOXIC_BYTES, 24), toxic, ordinary)
    model = Model(plain, b"".join(b" " + s for s in segments))
    if segments:
        pattern = re.compile(b"|".join(re.escape(g) for g in sorted(model.grams())))
        near = Counter(w for words in ordinary for w in words if pattern.search(b" %b " % w))
        extra = b""
        for w, _ in sorted(near.items(), key=lambda x: (-x[1], x[0])):
            if len(extra) + len(w) + 1 > NEAR_BYTES:
                break
            extra = b" " + w + extra
        model.ordinary = plain + extra
    del toxic, ordinary
    found = [d for part in _pieces([t for t, _ in rows]) for d in model.differences(part).tolist()]
    model.chance = _pooled(found, [y for _, y in rows], totals)
    trim()
    return model


def with_scores(df: DataFrame, text: str, model: Model) -> DataFrame:
    """(row: all columns of `df` as a struct, score: 0 to 1)."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    schema = T.StructType([*packed.schema.fields, T.StructField("score", T.DoubleType())])
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        chance = np.array(sent.value.chance)
        for part in slices(batches, f"row.{text}", SLICE_BYTES):
            scores = chance[np.minimum(sent.value.differences(texts_of(part, f"row.{text}")), len(chance) - 1)]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(scores)], ["row", "score"])

    return map_arrow(packed, run, schema)
