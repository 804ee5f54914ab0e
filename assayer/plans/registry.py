"""Registered queries: a Spark callable over the given tables and, where SQL can say it, the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import rnd

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round all doubles, print dates as text, widen counts, so that two engines print the same."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = rnd(c, special.get(name, digits))
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind in ("int", "smallint", "tinyint", "bigint"):
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)


def R(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)


def D(*cols: str) -> str:
    return ", ".join(f"strftime({c}, '%Y-%m-%d') AS {c}" for c in cols)


def B(*cols: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cols)
