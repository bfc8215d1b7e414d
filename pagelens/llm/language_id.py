"""Language of pages and documents by Bayesian fusion of independent evidence.

For a row with text x, declared language m, language step of the path p, and a host h with address suffix s,
and each language k:

    log P(k | x, m, p, s, h) = log P(k | h) + a * log P(x | k) + log P(m | k) + log P(p | k) + log P(s | k) - log Z

* text: character trigrams, hashed to a fixed table, multinomial and add-one smoothed; trained on a
  bounded, documented sample of the different texts with a declared language (those of the lowest hashes). Trigrams of one
  text depend on each other, so their log likelihood counts as that of at most `TEXT_WEIGHT` trigrams.
* declared language and path step: smoothed tables of how often each value meets each language, where the
  language is the one the text alone gives; grouped aggregation over all rows.
* address suffix: the same for the last label of the host, whatever its value. Hosts of one label and numeric addresses have none.
* host: prior counts of the host, smoothed towards those of its parent domain, and these towards all rows; grouped
  aggregation over all rows, pre-aggregated before each shuffle. The suffix is evidence of its own, so it is no level
  of the prior. A host with a large share of all rows is joined by broadcast, all others by a shuffle.

Every declared language that has a text is a class. Training reads the texts twice, whatever the number of languages;
texts are scored against `BLOCK` languages in one pass, so no broadcast grows with their number.

A row is rejected if no language reaches `least` posterior probability, or if its text has no letter
and neither the declared language nor the path step speaks for one (a host alone does not). Results for odd input: null,
empty and letterless texts say nothing and the other evidence decides; very long texts are read whole, one at a time; a null or
unknown declared language, path step or host says nothing; of equally likely languages the first by name is given; repeated
rows are judged each (but a repeated text trains once); without any declared language there is nothing to train on and every row
is rejected; an empty table gives an empty result; columns of any name travel inside `row`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pagelens.llm.shipping import map_arrow
from pagelens.llm.words import byte_table, slices, text_bytes
from pagelens.operators.skew import lookup
from pagelens.session import scratch_path

#: Texts of each language that training reads at most; each of them whole.
SAMPLE = 500
BUCKETS = 1 << 16
TEXT_WEIGHT = 200.0
#: Rows that a level of the host hierarchy counts as, seen from the level below.
STRENGTH = 4.0
HOT_ROWS = 10_000
LEAST = 0.5
#: Languages that texts are scored against in one pass (16 MB of broadcast).
BLOCK = 64
#: Of these, languages looked at together in a task.
COLUMNS = 16
#: Everything but letters and non-ASCII bytes is a blank; letters are lowered.
LETTERS = byte_table("".join(chr(c) for c in range(128) if not chr(c).isalpha()), lower=True)
CHUNK = 1 << 18
#: Trigrams take a few dozen bytes for each byte of text.
SLICE_BYTES = 2 << 20


@dataclass
class TextModel:
    languages: list[str]
    blocks: list[np.ndarray]  # log P(bucket | language), each BUCKETS x at most BLOCK languages


def likelihoods(table: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tempered log likelihood of each text under each language of `table`, zeros for texts without letters; which have letters."""
    codes, owner, counts = trigrams(texts)
    out = np.zeros((len(texts), table.shape[1]))
    for lo in range(0, table.shape[1], COLUMNS):
        some = np.ascontiguousarray(table[:, lo : lo + COLUMNS])
        for at in range(0, len(codes), CHUNK):
            own = owner[at : at + CHUNK]
            firsts = np.flatnonzero(np.diff(own, prepend=-1))
            out[own[firsts], lo : lo + COLUMNS] += np.add.reduceat(some[codes[at : at + CHUNK]], firsts, axis=0, dtype=np.float64)
    return out * np.minimum(1.0, TEXT_WEIGHT / np.maximum(counts, 1))[:, None], counts > 0


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of each byte trigram with a letter in its middle or at its end, and their number by text."""
    raw, offsets = text_bytes(texts)
    data = LETTERS[raw].astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    codes = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    keep = (data[1:-1] != 32) | (data[2:] != 32)
    # None may reach from one text into the next.
    for k in (1, 2):
        edges = offsets[1:-1] - k
        keep[edges[(edges >= 0) & (edges < len(keep))]] = False
    keep &= (data[:-2] != 32) | (data[1:-1] != 32)
    at = np.flatnonzero(keep)
    owner = np.searchsorted(offsets, at, side="right") - 1
    mixed = (codes[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return mixed.astype(np.int64), owner, np.bincount(owner, minlength=len(texts))


def _written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def train_text(df: DataFrame, text: str, declared: str, sample: int = SAMPLE) -> TextModel:
    """Trigram tables of all declared languages, of the `sample` different texts of the lowest hashes of each."""
    known = df.filter(F.col(declared).isNotNull() & F.col(text).isNotNull()).select(
        F.col(declared).alias("k"), F.xxhash64(text).alias("o"), F.col(text).alias("t")
    )

    def lowest(batches):
        kept = pd.DataFrame({"k": pd.Series(dtype=str), "o": pd.Series(dtype="int64")})
        for batch in batches:
            both = pd.concat([kept, batch.to_pandas()]).drop_duplicates()
            kept = both.sort_values("o").groupby("k").head(sample)
        yield pa.RecordBatch.from_arrays([pa.array(kept["k"], pa.string()), pa.array(kept["o"], pa.int64())], ["k", "o"])

    # Each task hands on its lowest hashes of each language only, and no text.
    nth = F.row_number().over(W.partitionBy("k").orderBy("o"))
    low = map_arrow(known.select("k", "o"), lowest, "k string, o bigint").distinct().withColumn("nth", nth).filter(F.col("nth") <= sample)
    limits = _written(low.groupBy("k").agg(F.max("o").alias("most")), "language-limits")
    languages = sorted(r["k"] for r in limits.select("k").collect())

    def count(batches):
        for part in slices(batches, "t", SLICE_BYTES):
            codes, owner, _ = trigrams(part.column("t"))
            named = part.column("k").dictionary_encode()
            both, n = np.unique(named.indices.to_numpy()[owner].astype(np.int64) * BUCKETS + codes, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [named.dictionary.take(pa.array(both // BUCKETS)), pa.array(both % BUCKETS), pa.array(n)], ["k", "bucket", "n"]
            )

    chosen = known.join(F.broadcast(limits), "k").filter(F.col("o") <= F.col("most")).groupBy("k", "o").agg(F.first("t").alias("t"))
    counts = map_arrow(chosen.select("k", "t"), count, "k string, bucket bigint, n bigint").groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    counts = _written(counts, "trigrams")
    blocks = []
    for lo in range(0, len(languages), BLOCK):
        own = languages[lo : lo + BLOCK]
        found = counts.filter(F.col("k").between(own[0], own[-1])).toPandas()
        table = np.ones((BUCKETS, len(own)))
        np.add.at(table, (found["bucket"].to_numpy(), np.searchsorted(own, found["k"].to_numpy(dtype=str))), found["n"].to_numpy())
        blocks.append(np.log(table / table.sum(axis=0)).astype(np.float32))
    return TextModel(languages, blocks)


def host_levels(host: Column) -> dict[str, Column]:
    """The parent domain (last two labels) and address suffix (last label; empty for one label and for numbers), lower case."""
    labels = F.split(F.lower(host), r"\.")
    n = F.size(labels)
    last = F.element_at(labels, -1)
    return {
        "domain": F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), "."),
        "suffix": F.when((n > 1) & ~last.rlike(r"^[0-9]*$"), last).otherwise(""),
    }


def address_host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def address_language(url: Column) -> Column:
    """A two-letter first path step, which many sites use for the language."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([a-zA-Z]{2})(?:[/?#.]|$)", 1)), F.lit(""))


def markup_language(html: Column) -> Column:
    """The declared language of a page, without region."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1)), F.lit(""))


def _by_language(counts: DataFrame, key: str, size: int) -> DataFrame:
    """(key, n rows, c: rows of each language) of `counts` (key, best, n)."""
    found = F.collect_list(F.when(F.col("best").isNotNull(), F.struct("best", "n")))
    each = counts.groupBy(key, "best").agg(F.sum("n").alias("n")).groupBy(key)
    each = each.agg(F.sum("n").alias("n"), F.map_from_entries(found).alias("found"))
    listed = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.coalesce(F.try_element_at("found", j), F.lit(0)).cast("double"))
    return each.select(key, "n", listed.alias("c"))


def _totals(counts: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size)
    for best, n in counts.filter("best IS NOT NULL").groupBy("best").agg(F.sum("n")).collect():
        out[best] = n
    return out


def _numbers(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def _smoothed(parent: Column) -> Column:
    seen = F.aggregate("c", F.lit(STRENGTH), lambda s, x: s + x)
    return F.zip_with("c", parent, lambda x, p: (x + STRENGTH * p) / seen)


def _rates(spark: SparkSession, counts: DataFrame, languages: list[str], rates: str) -> DataFrame:
    """(v, log P(v | language)) of the values that name a language, add-one smoothed; at most one row a language."""
    found = counts.filter("best IS NOT NULL").collect()
    values = sorted({r["v"] for r in found})
    table = np.ones((len(values), len(languages)))
    for r in found:
        table[values.index(r["v"]), r["best"]] += r["n"]
    logs = np.log(table / table.sum(axis=0))
    return spark.createDataFrame([(v, logs[i].tolist()) for i, v in enumerate(values)], f"v string, {rates} array<double>")


def _host_evidence(scored: DataFrame, size: int, hot_rows: int) -> tuple[DataFrame, np.ndarray]:
    """(h, prior: log P(k | h) + log P(suffix | k), n rows of the host), and the shares of all rows."""
    by = _written(scored.groupBy("h", "best").agg(F.count(F.lit(1)).alias("n")), "hosts")
    whole = _totals(by, size) + 1
    whole /= whole.sum()
    by = by.filter(F.col("h").isNotNull())
    levels = host_levels(F.col("h"))
    hosts = _written(_by_language(by, "h", size).withColumns(levels), "host-counts")

    above = by.withColumns(levels)
    domains = _by_language(above, "domain", size).select("domain", "n", _smoothed(_numbers(whole)).alias("up"))
    suffixes = _written(_by_language(above, "suffix", size), "suffixes")
    named = F.col("suffix") != ""
    n_values, totals = suffixes.filter(named).count(), _totals(above.filter(named), size)
    rate = F.zip_with("c", _numbers(totals), lambda x, t: F.when(named, F.log((x + 1) / (t + n_values))).otherwise(0.0))
    suffixes = suffixes.select("suffix", "n", rate.alias("rate"))
    # A domain or suffix has at most as many hosts as rows, so its row count bounds the join's hot keys.
    out = hosts.select("h", "c", F.col("n").alias("rows"), "domain", "suffix")
    out = lookup(out, _written(domains, "domains"), "domain", hot_rows)
    out = _written(out.select("h", "rows", "suffix", _smoothed(F.col("up")).alias("prior")), "host-shares")
    out = lookup(out, suffixes, "suffix", hot_rows)
    logs = F.zip_with("prior", "rate", lambda p, r: F.log(p) + r)
    return _written(out.select("h", logs.alias("prior"), F.col("rows").alias("n")), "host-priors"), whole


def _scored(packed: DataFrame, model: TextModel) -> DataFrame:
    """`packed` with the texts replaced by (logs: of each language, best: place of the greatest, letters)."""
    spark = packed.sparkSession
    plain = [f for f in packed.schema.fields if f.name != "text"]
    found = packed.withColumn("logs", F.array().cast("array<double>"))
    for nth, block in enumerate(model.blocks):
        last = nth == len(model.blocks) - 1
        extra = [T.StructField("best", T.IntegerType()), T.StructField("letters", T.BooleanType())] if last else [packed.schema["text"]]
        schema = T.StructType([*plain, T.StructField("logs", T.ArrayType(T.DoubleType())), *extra])
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent, last=last, names=[f.name for f in schema.fields]):
            for part in slices(batches, "text", SLICE_BYTES):
                own, letters = likelihoods(sent.value, part.column("text"))
                before = part.column("logs").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                logs = np.concatenate([before, own], axis=1)
                ends = np.arange(len(logs) + 1, dtype=np.int32) * logs.shape[1]
                made = {"logs": pa.ListArray.from_arrays(ends, pa.array(logs.ravel()))}
                if last:
                    made |= {"best": pa.array(logs.argmax(axis=1).astype(np.int32), mask=~letters), "letters": pa.array(letters)}
                yield pa.RecordBatch.from_arrays([made[c] if c in made else part.column(c) for c in names], names)

        found = _written(map_arrow(found, run, schema), "languages", "zstd")  # whole texts
    return found


def identify(
    df: DataFrame, text: str, declared: str | None = None, step: str | None = None, host: str | None = None,
    model: TextModel | None = None, least: float = LEAST, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(row: all columns of `df` as a struct, language, probability, text_language, accepted).

    `declared`, `step` (of the path) and `host` name columns of `df`; the text model is trained on `df` unless given.
    """
    null = F.lit(None).cast("string")
    columns = {"m": declared, "s": step, "h": host}
    packed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text}`").alias("text"),
        *[(F.lower(F.col(f"`{c}`")) if c else null).alias(n) for n, c in columns.items()],
    )
    model = model or train_text(packed, "text", "m")
    languages, spark = model.languages, df.sparkSession
    size = len(languages)
    if not size:
        return packed.select(
            "row", null.alias("language"), F.lit(0.0).alias("probability"), null.alias("text_language"), F.lit(False).alias("accepted")
        )
    scored = _scored(packed, model)
    hosts, whole = _host_evidence(scored, size, hot_rows)
    out = lookup(scored.filter(F.col("h").isNotNull()), hosts, "h", hot_rows)
    out = out.unionByName(scored.filter(F.col("h").isNull()).withColumn("prior", _numbers(np.log(whole))))
    logs = F.zip_with("prior", "logs", lambda p, x: p + x)
    for name in ("m", "s"):
        # Values that are no language say nothing.
        counts = scored.filter(F.col(name).isin(*languages)).groupBy(F.col(name).alias("v"), "best").agg(F.count(F.lit(1)).alias("n"))
        rates = _rates(spark, counts, languages, f"{name}_rates").withColumnRenamed("v", name)
        out = out.join(F.broadcast(rates), name, "left")
        logs = F.zip_with(logs, F.coalesce(f"{name}_rates", _numbers(np.zeros(size))), lambda a, b: a + b)
    names = F.array(*[F.lit(k) for k in languages])
    out = out.withColumn("logs", logs)
    top = F.array_max("logs")
    out = out.withColumns(
        {
            "place": F.array_position("logs", top).cast("int"),
            "probability": 1.0 / F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - top)),
        }
    )
    # A host says what its other rows are like; of a text without letters that is no evidence.
    speaks = F.col("letters") | F.coalesce(F.col("m").isin(*languages), F.lit(False)) | F.coalesce(F.col("s").isin(*languages), F.lit(False))
    return out.select(
        "row",
        F.get(names, F.col("place") - 1).alias("language"),
        "probability",
        F.get(names, F.col("best")).alias("text_language"),
        ((F.col("probability") >= least) & speaks).alias("accepted"),
    )
