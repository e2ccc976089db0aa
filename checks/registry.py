"""Registration of checks and the SQL prefix their twins share."""

from __future__ import annotations

import re
from collections.abc import Callable
from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.oracle_views import VIEWS
from checks.views import Tables
from shelfmark.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it names, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", text):
            if name in VIEWS and name not in ordered:
                visit(VIEWS[name])
                ordered.append(name)

    visit(sql)
    if not ordered:
        return dedent(sql).strip()
    prefix = ",\n".join(f"{name} AS ({dedent(VIEWS[name]).strip()})" for name in ordered)
    body = dedent(sql).strip()
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {prefix},\n{body[len('WITH RECURSIVE'):].strip()}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {prefix},\n{body[4:].strip()}"
    return f"WITH {prefix}\n{body}"


def plain(df: DataFrame) -> DataFrame:
    """Flatten a result for comparison: integers as BIGINT, sets as joined text,
    instants and dates as text to the second."""
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), "|")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def check(name: str, sql: str | None = None, ints: str = ""):
    """Register ``job(tables)`` under ``name``; ``sql`` is the DuckDB twin.

    ``ints`` names the twin's columns that must become BIGINT.
    """

    def register(job):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return plain(job(Tables(spark, sf_dir)))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            twin = with_views(sql)
            if ints:
                casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ints.split())
                twin = f"SELECT * REPLACE ({casts}) FROM ({twin})"
            ORACLES[name] = twin
        return job

    return register
