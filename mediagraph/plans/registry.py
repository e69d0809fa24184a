"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediagraph.plans.bindings import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """UTC instants leave as zone-less timestamps, which compare the same whatever zone the reader is in."""
    return df.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
        for f in df.schema.fields])


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None):
    """Register a `Tables -> DataFrame` function; `sql` follows the WITH clause of its `views` (start further views
    with a comma)."""

    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: plain(build(Tables(spark, folder)))
        if sql is not None:
            ORACLES[name] = f"{with_views(*views)}\n{sql}" if views else sql
        return build

    return add
