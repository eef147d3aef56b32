"""Where registered queries are kept."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plotweave.session import tune
from plotweave.views import Views, sql_over_views


@dataclass
class Entry:
    build: Callable[[Views], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, **extra_views: str):
    """Register a query under the survey's operator name."""

    def keep(build: Callable[[Views], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"{name} is registered twice")
        ENTRIES[name] = Entry(build, sql_over_views(sql, extra_views) if sql else None)
        return build

    return keep


def runner(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return entry.build(Views(tune(spark), folder))

    return run
