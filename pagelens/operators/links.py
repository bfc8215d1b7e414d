"""Link edges and per-host link counts from page records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def host_of(url):
    """Host part of an address, lower-cased."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def edges(records: DataFrame) -> DataFrame:
    """(page_id, src_url, position, dst_url, text), one row per link."""
    return records.select(
        "page_id", F.col("url").alias("src_url"), F.posexplode_outer("links").alias("i", "l")
    ).select(
        "page_id", "src_url", (F.col("i") + 1).cast("bigint").alias("position"), F.col("l.url").alias("dst_url"), "l.text"
    ).filter("dst_url IS NOT NULL")


def host_counts(links: DataFrame) -> DataFrame:
    """Outgoing and incoming links and distinct targets per host.

    Distinct targets are counted in two steps, so a host that owns a third of the
    links is first reduced by (host, target) over all tasks.
    """
    pairs = links.groupBy(host_of("src_url").alias("src"), host_of("dst_url").alias("dst"), "dst_url").agg(
        F.count(F.lit(1)).alias("n")
    )
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("src").alias("host"), F.col("n").alias("out_links"), F.lit(0).cast("bigint").alias("in_links"),
                    F.lit(1).cast("bigint").alias("targets"),
                ),
                F.struct(
                    F.col("dst").alias("host"), F.lit(0).cast("bigint").alias("out_links"), F.col("n").alias("in_links"),
                    F.lit(0).cast("bigint").alias("targets"),
                ),
            )
        ).alias("x")
    )
    return sides.groupBy("x.host").agg(
        F.sum("x.out_links").alias("out_links"),
        F.sum("x.in_links").alias("in_links"),
        F.sum("x.targets").alias("distinct_targets"),
    )
