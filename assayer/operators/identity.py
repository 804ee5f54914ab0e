"""Structure, dictionary, fingerprints, differences and guarded writes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from assayer.functions import rows_of, spread, wide_rows
from assayer.functions.ranks import _null_safe


def describe_structure(df: DataFrame, name: str, declared_columns: Sequence[str] | None = None,
                       declared_rows: int | None = None, declared_name: str | None = None) -> DataFrame:
    """Rows, columns, column order and agreement with what was declared. One count over the scan."""
    columns = df.columns
    count = F.count(F.lit(1))
    yes = lambda wanted, ok: F.lit(None).cast("boolean") if wanted is None else ok
    return df.agg(
        F.lit(name).alias("table_name"), count.alias("row_count"), F.lit(len(columns)).cast("bigint").alias("column_count"),
        F.lit(",".join(columns)).alias("column_order"),
        yes(declared_columns, F.lit(sorted(columns) == sorted(declared_columns or ()))).alias("columns_match"),
        yes(declared_columns, F.lit(list(columns) == list(declared_columns or ()))).alias("order_matches"),
        yes(declared_rows, count == F.lit(declared_rows or 0)).alias("rows_match"),
        yes(declared_name, F.lit(name == declared_name)).alias("source_matches"))


def dictionary(df: DataFrame, metadata: DataFrame, roles: Mapping[str, str], low_cardinality: int = 20) -> DataFrame:
    """Data columns joined with the variable table: roles, documentation status and observed counts."""
    counts = wide_rows(df, df.columns, {
        "non_null": lambda c: F.count(c), "distinct_values": lambda c: F.count_distinct(c)}, name="name")
    role = F.create_map(*[x for k, v in roles.items() for x in (F.lit(k), F.lit(v))]) if roles else F.create_map()
    position = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    meta = metadata.select("name", F.col("role").alias("source_role"), F.col("type").alias("source_type"), "description",
                           F.lit(True).alias("_m"))
    joined = counts.join(F.broadcast(meta), "name", "full_outer")
    status = (
        F.when(F.col("non_null").isNull(), "Missing from data")
        .when(F.col("_m").isNull() | (F.coalesce(F.trim("description"), F.lit("")) == ""), "Undocumented")
        .otherwise("Documented"))
    analytic = F.coalesce(role[F.col("name")], F.lit("unassigned"))
    return joined.select(
        "name", F.coalesce(position[F.col("name")], F.lit(-1)).cast("bigint").alias("position"),
        analytic.alias("analytical_role"), "source_role", "source_type", "description", "non_null", "distinct_values",
        (F.lower(F.coalesce("source_role", F.lit(""))) == analytic).alias("role_agrees"), status.alias("status"))


def dictionary_coverage(entries: DataFrame) -> DataFrame:
    return entries.groupBy("status").agg(F.count(F.lit(1)).alias("columns"))


def canonical(c: str, kind: T.DataType) -> Column:
    """Unambiguous text of a typed value: length-prefixed, -0.0 as 0.0, NULL and NaN as one missing tag."""
    x = F.col(c)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        x = F.when(~F.isnan(x), x + F.lit(0.0))
    text = x.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """SHA-256 over the canonical values of the chosen columns."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.sha2(F.concat_ws("|", *[canonical(c, kinds[c]) for c in (columns or df.columns)]), 256)


def occurrence_keys(df: DataFrame, position: str, columns: Sequence[str], width: int = 1_000_000) -> DataFrame:
    """Row hash and the ordinal of the row among equal rows, by position.

    Copies are counted per range of `width` positions first, so a hash shared by a third of all
    rows is numbered range by range in parallel, never in one task.
    """
    df = spread(df.select(position, *columns))
    hashed = df.select(position, row_fingerprint(df, columns).alias("row_hash")).withColumn(
        "_b", F.floor(F.col(position) / width))
    inside = Window.partitionBy("row_hash", "_b").orderBy(position)
    earlier = Window.partitionBy("row_hash").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy("row_hash", "_b").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select("row_hash", "_b", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_o"))
    local = hashed.withColumn("_l", F.row_number().over(inside) - 1)
    return _null_safe(local, offsets, ["row_hash", "_b"]).select(
        position, "row_hash", (F.col("_o") + F.col("_l")).alias("ordinal"))


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-insensitive fingerprint: row count, two sums of 64 bits each of the row hashes, and a schema hash. One aggregate."""
    columns = list(columns or df.columns)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = "|".join(f"{c}:{kinds[c]}" for c in columns)
    df = spread(df.select(*columns))
    part = lambda at: F.conv(F.substring("_h", at, 16), 16, 10).cast("decimal(38,0)")
    total = lambda at: F.coalesce(F.sum(part(at)), F.lit(0)).cast("decimal(38,0)").cast("string")
    return df.select(row_fingerprint(df, columns).alias("_h")).agg(
        F.count(F.lit(1)).alias("row_count"), total(1).alias("hash_sum"), total(17).alias("hash_sum_2"),
        F.sha2(F.lit(schema), 256).alias("schema_hash"))


def _exists(df: DataFrame, path: str) -> bool:
    try:
        df.sparkSession.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def write_once(df: DataFrame, path: str) -> str:
    """Write a table unless the same rows are already there: `new`, `equivalent` or `divergent`.

    A divergent target is left as it is. Fingerprints, not rows, reach the driver.
    """
    if not _exists(df, path):
        df.write.mode("errorifexists").parquet(path)
        return "new"
    stored = df.sparkSession.read.parquet(path)
    if [(n, t) for n, t in stored.dtypes] != [(n, t) for n, t in df.dtypes]:
        return "divergent"
    same = table_fingerprint(stored).first() == table_fingerprint(df).first()
    return "equivalent" if same else "divergent"


def table_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: float = 0.0,
               tolerances: Mapping[str, float] | None = None) -> DataFrame:
    """Per column: compared and differing rows and the largest numeric difference; key presence on both sides.

    Numbers differ beyond their tolerance, other types by null-safe equality. Row order plays no part. Pairs with a
    number that is not finite are counted apart and not measured. `repeated_keys` counts keys that a side has more than
    once, `other_columns` those that one side lacks; a column of the left side that the right lacks is not compared.
    """
    keys = list(keys)
    columns = [c for c in left.columns if c not in keys and c in right.columns]
    other = len(set(left.columns) ^ set(right.columns))
    kinds = {f.name: f.dataType for f in left.schema.fields}
    l = left.select(*keys, *[F.col(c).alias(f"_l_{c}") for c in columns], F.lit(1).alias("_in_l"))
    r = right.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in columns], F.lit(1).alias("_in_r"))
    both = l.join(r, keys, "full_outer")
    paired = F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull()
    aggs = [F.count_if(F.col("_in_r").isNull()).alias("left_only"), F.count_if(F.col("_in_l").isNull()).alias("right_only"),
            F.count_if(paired).alias("compared")]
    for c in columns:
        a, b = F.col(f"_l_{c}"), F.col(f"_r_{c}")
        odd = F.lit(False)
        if isinstance(kinds[c], T.NumericType):
            a, b = a.cast("double"), b.cast("double")
            infinite = lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False))
            odd = infinite(a) | infinite(b)
            gap = F.when(~odd, F.abs(a - b))
            limit = (tolerances or {}).get(c, tolerance)
            unequal = F.when(odd, ~a.eqNullSafe(b)).otherwise(F.coalesce(gap > limit, F.lit(False)) | (a.isNull() != b.isNull()))
        else:
            gap, unequal = F.lit(None).cast("double"), ~a.eqNullSafe(b)
        aggs += [F.count_if(paired & unequal).alias(f"_n_{c}"), F.max(F.when(paired, gap)).alias(f"_g_{c}"), F.count_if(paired & odd).alias(f"_o_{c}")]
    repeated = left.select(*keys, F.lit(0).alias("_s")).union(right.select(*keys, F.lit(1).alias("_s"))).groupBy("_s", *keys).agg(
        F.count(F.lit(1)).alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("repeated_keys"))
    wide = both.agg(*aggs).join(F.broadcast(repeated)).withColumn("other_columns", F.lit(other).cast("bigint"))
    return rows_of(wide, [{
        "column": F.lit(c), "position": F.lit(i).cast("bigint"), "differing": F.col(f"_n_{c}"),
        "max_abs_difference": F.col(f"_g_{c}"), "non_finite": F.col(f"_o_{c}")} for i, c in enumerate(columns)],
        keep=["left_only", "right_only", "compared", "repeated_keys", "other_columns"])


def diff_verdict(diff: DataFrame) -> DataFrame:
    """One row: equivalent or not, and the first column that differs. Repeated keys, unequal column sets and numbers
    that are not finite rule equivalence out."""
    bad = F.col("differing") > 0
    faults = reduce(lambda a, b: a + b, [F.col(c) for c in ("left_only", "right_only", "differing", "repeated_keys", "other_columns", "non_finite")])
    return diff.agg(
        (F.max(faults) == 0).alias("equivalent"), F.min_by(F.when(bad, F.col("column")), F.when(bad, F.col("position"))).alias("first_differing"),
        F.sum("differing").cast("bigint").alias("differing_cells"), F.max("max_abs_difference").alias("max_abs_difference"))


def _close(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def evidence_audit(ev: DataFrame, truth: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Recompute the derived columns of backtest evidence and its truth; violations per candidate."""
    t = truth.select("series_id", "period", F.col("y").alias("_truth"))
    e = F.col("y_pred") - F.col("y_true")
    checks = {
        "truth_violations": _close(F.col("y_true"), F.col("_truth"), tolerance),
        "error_violations": _close(F.col("error"), e, tolerance),
        "abs_violations": _close(F.col("abs_error"), F.abs(e), tolerance),
        "squared_violations": _close(F.col("squared_error"), e * e, tolerance),
        "scaled_violations": _close(F.col("scaled_abs_error"), F.abs(e) / F.col("mase_scale"), tolerance),
    }
    joined = ev.join(t, ["series_id", "period"], "left")
    return joined.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, ok in checks.items()])
