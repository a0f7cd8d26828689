"""The registered queries by name, each with its SQL or None."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None):
    def add(run):
        QUERIES[run.__name__] = Query(run, sql)
        return run

    return add
