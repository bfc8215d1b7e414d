"""A registered query: its Spark form, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pagelens.session import spread
from pagelens.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    covers: str
    run: Query
    sql: str | None = None


class Registry(list):
    """Entries in definition order."""

    def add(self, name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(run: Query) -> Query:
            self.append(Entry(name, covers, run, sql))
            return run

        return register


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "pages"), "page_id")
