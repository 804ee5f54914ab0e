"""Moving between one wide row and many long rows without extra scans."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.columns import clean


#: Session setting: deal input rows out to so many partitions before work that multiplies them. Unset on a cluster,
#: where the splits of the input are many.
INPUT_PARTITIONS = "spark.assayer.inputPartitions"


def spread(df: DataFrame) -> DataFrame:
    """The rows in as many partitions as the session asks for, else as they are."""
    n = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def long_form(df: DataFrame, keep: Sequence[str], columns: Sequence[str], name: str = "feature",
              value: str = "value") -> DataFrame:
    """One row per (row, column) with the value as a double and NaN as NULL."""
    shaped = spread(df.select(*keep, *columns)).select(*keep, *[clean(c).alias(c) for c in columns])
    return shaped.unpivot(list(keep), list(columns), name, value)


def rows_of(df: DataFrame, rows: Iterable[Mapping[str, Column]], keep: Sequence[str] = ()) -> DataFrame:
    """Explode every row of df into the listed rows; all share the same column names and types."""
    structs = [F.struct(*[c.alias(k) for k, c in row.items()]) for row in rows]
    return df.select(*keep, F.inline(F.array(*structs)))


def wide_rows(df: DataFrame, columns: Sequence[str], measures: Mapping[str, object], by: Sequence[str] = (),
              name: str = "feature") -> DataFrame:
    """All measures of all columns in one aggregate over one scan, then one row per column.

    `measures` maps an output name to a function column name -> aggregate Column.
    """
    aggs = [fn(c).alias(f"_{i}_{m}") for i, c in enumerate(columns) for m, fn in measures.items()]
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return rows_of(
        wide,
        [{name: F.lit(c), **{m: F.col(f"_{i}_{m}") for m in measures}} for i, c in enumerate(columns)],
        keep=by,
    )
