"""Registry of named queries and the SQL text that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    build: Build
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def _iso(df: DataFrame) -> DataFrame:
    """Dates and timestamps leave the registry as ISO text, the form of the chart payloads."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DateType):
            out[f.name] = F.col(f.name).cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out[f.name] = F.date_format(f.name, "yyyy-MM-dd HH:mm:ss")
    return df.withColumns(out) if out else df


def shown(col: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison. Sums of the same values differ in their last bits between engines,
    so a value half way between two decimals is first moved off the tie, here and in the SQL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c + 1e-9, digits)


def query(name: str, sql: str | None = None, dates: tuple = (), stamps: tuple = ()):
    """Register ``fn(spark, sf_dir)``; ``dates``/``stamps`` name the columns the SQL renders as text."""
    if sql is not None and (dates or stamps):
        reps = [f"CAST({c} AS VARCHAR) AS {c}" for c in dates]
        reps += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in stamps]
        sql = f"SELECT * REPLACE ({', '.join(reps)}) FROM (\n{sql}\n) AS shown"

    def wrap(fn: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Entry(name, lambda spark, d: _iso(fn(spark, d)), sql)
        return fn

    return wrap
