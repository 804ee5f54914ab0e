"""Validation: observation unit, types, value rules, domains, relations, duplicates, contracts, findings.

All counts of one table come from one wide aggregate (partial aggregation before the shuffle), then
become one row per column or check.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from assayer.functions import clean, is_blank, parse_number, rows_of, spread, strip_text, to_text, wide_rows
from assayer.operators.identity import row_fingerprint


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def any_of(masks: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, masks, F.lit(False))


def is_missing(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.col(c).isNull() | F.isnan(c)
    return F.col(c).isNull()


# --- projections ---------------------------------------------------------------------------------------------

def numeric_projection(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (),
                       blank_to: Mapping[str, tuple[str, object, float]] | None = None) -> DataFrame:
    """One struct per feature: number, and the masks missing, blank, non_numeric, materialized, condition_failed.

    `blank_to[c] = (other, value, number)` turns a blank of c into `number` where other = value; a blank
    elsewhere counts as a failed condition.
    """
    out = []
    for c in columns:
        missing = is_missing(df, c)
        numeric = isinstance(df.schema[c].dataType, T.NumericType)
        blank = F.lit(False) if numeric else is_blank(to_text(c))
        parsed = clean(c) if numeric else parse_number(c)
        made, failed, value = F.lit(False), F.lit(False), parsed
        if blank_to and c in blank_to:
            other, wanted, number = blank_to[c]
            hit = flag(F.col(other) == F.lit(wanted))
            made, failed = blank & hit, blank & ~hit
            value = F.when(made, F.lit(float(number))).otherwise(parsed)
        out.append(F.struct(
            value.alias("number"), missing.alias("missing"), (blank & ~made).alias("blank"),
            (~missing & ~blank & parsed.isNull()).alias("non_numeric"), made.alias("materialized"),
            failed.alias("condition_failed")).alias(c))
    return df.select(*keep, *out)


def projection_counts(projected: DataFrame, columns: Sequence[str]) -> DataFrame:
    masks = ("missing", "blank", "non_numeric", "materialized", "condition_failed")
    return wide_rows(projected, columns, {
        "row_count": lambda c: F.count(F.lit(1)), "valid": lambda c: F.count(F.col(c)["number"]),
        **{f"{m}_count": (lambda c, m=m: F.count_if(F.col(c)[m])) for m in masks}})


def materialize_blanks(df: DataFrame, column: str, condition: str, value: object, number: float,
                       strict: bool = False) -> DataFrame:
    """Replace blanks of a text column by a number where the condition column has the value; cast the rest."""
    blank = is_blank(column)
    hit = flag(F.col(condition) == F.lit(value))
    other = parse_number(column)
    if strict:
        bad = F.raise_error(F.concat(F.lit(f"{column}: blank or unreadable value "), F.coalesce(column, F.lit("NULL"))))
        other = F.when(F.col(column).isNull() | other.isNotNull(), other).otherwise(bad.cast("double"))
    return df.withColumn(column, F.when(blank & hit, F.lit(float(number))).otherwise(other))


def change_audit(raw: DataFrame, prepared: DataFrame, keys: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Changed cells per column between two tables of the same keys; only `allowed` may change.

    Rows that only one side has are lost or added, keys that a side has more than once are repeated; with any of these
    nothing is in order, whatever the cells say. NULL keys are keys like others.
    """
    columns = [c for c in raw.columns if c not in keys]
    l = raw.select(*[F.col(k).alias(f"_lk_{k}") for k in keys], *[to_text(c).alias(f"_l_{c}") for c in columns], F.lit(1).alias("_in_l"))
    r = prepared.select(*[F.col(k).alias(f"_rk_{k}") for k in keys], *[to_text(c).alias(f"_r_{c}") for c in columns], F.lit(1).alias("_in_r"))
    paired = F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull()
    wide = l.join(r, [F.col(f"_lk_{k}").eqNullSafe(F.col(f"_rk_{k}")) for k in keys], "full_outer").agg(
        F.count_if(paired).alias("row_count"), F.count_if(F.col("_in_r").isNull()).alias("lost"), F.count_if(F.col("_in_l").isNull()).alias("added"),
        *[F.count_if(paired & ~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}"))).alias(f"_n_{c}") for c in columns])
    repeated = raw.select(*keys, F.lit(0).alias("_s")).union(prepared.select(*keys, F.lit(1).alias("_s"))).groupBy("_s", *keys).agg(
        F.count(F.lit(1)).alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("repeated"))
    whole = (F.col("lost") == 0) & (F.col("added") == 0) & (F.col("repeated") == 0)
    return rows_of(wide.join(F.broadcast(repeated)), [{
        "column": F.lit(c), "changed": F.col(f"_n_{c}"), "allowed": F.lit(c in allowed),
        "ok": whole & (F.lit(c in allowed) | (F.col(f"_n_{c}") == 0))} for c in columns], keep=["row_count", "lost", "added", "repeated"])


@dataclass(frozen=True)
class Roles:
    """Columns by their part in a study, in declared order."""
    identifiers: tuple[str, ...]
    features: tuple[str, ...]
    target: str

    def identifiers_of(self, df: DataFrame) -> DataFrame:
        return df.select(*self.identifiers)

    def features_of(self, df: DataFrame) -> DataFrame:
        return df.select(*self.identifiers, *self.features)

    def target_of(self, df: DataFrame) -> DataFrame:
        return df.select(*self.identifiers, self.target)

    def check(self, df: DataFrame) -> None:
        wanted = [*self.identifiers, *self.features, self.target]
        if len(set(wanted)) != len(wanted):
            raise ValueError("a column has two roles")
        absent = [c for c in wanted if c not in df.columns]
        if absent:
            raise ValueError(f"columns are missing: {absent}")


@dataclass(frozen=True)
class Expected:
    """Contract of one scoring column."""
    kind: str = "number"                  # number, integer or text
    nullable: bool = False
    minimum: float | None = None
    maximum: float | None = None
    allowed: tuple[str, ...] | None = None


def contract_violations(df: DataFrame, contract: Mapping[str, Expected], prohibited: Sequence[str] = ()) -> DataFrame:
    """Add `violations`, the sorted list of broken rules of each row. A projection, so valid on a stream too."""
    columns = df.columns
    numeric = {c: isinstance(df.schema[c].dataType, T.NumericType) for c in contract if c in columns and contract[c].kind != "text"}
    df = df if df.isStreaming else spread(df)
    df = df.withColumns({f"_x_{c}": F.col(c).cast("double") if n else parse_number(c) for c, n in numeric.items()})
    found = [F.lit(f"extra:{c}") for c in columns if c in prohibited]
    for c, rule in contract.items():
        if c not in columns:
            found.append(F.lit(f"missing:{c}"))
            continue
        missing = is_missing(df, c)
        say = lambda bad, what: F.when(flag(bad), F.lit(f"{what}:{c}"))
        if not rule.nullable:
            found.append(say(missing, "null"))
        if rule.kind == "text":
            found.append(say(is_blank(c), "blank"))
            if rule.allowed is not None:
                found.append(say(~missing & ~is_blank(c) & ~F.col(c).isin(*rule.allowed), "unknown"))
            continue
        x = F.col(f"_x_{c}")
        if not numeric[c]:
            found.append(say(~missing & x.isNull(), "type"))
        found.append(say(F.abs(x) == float("inf"), "infinite"))
        if rule.kind == "integer":
            found.append(say((F.abs(x) != float("inf")) & (F.abs(x - F.rint(x)) > 1e-12), "fraction"))
        if rule.minimum is not None:
            found.append(say(x < rule.minimum, "below"))
        if rule.maximum is not None:
            found.append(say(x > rule.maximum, "above"))
    return df.withColumn("violations", F.array_sort(F.array_compact(F.array(*found)))).select(*columns, "violations")


# --- observation unit, types, values ----------------------------------------------------------------------------

def observation_unit(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Completeness and uniqueness of the identifier: one count per identifier, then totals."""
    per_id = df.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n"))
    missing = any_of([F.col(c).isNull() for c in ids])
    totals = per_id.agg(
        F.sum("_n").alias("row_count"), F.sum(F.when(~missing, F.col("_n")).otherwise(0)).alias("non_null"),
        F.count_if(~missing).alias("unique_ids"), F.sum(F.when(missing, F.col("_n")).otherwise(0)).alias("missing"),
        F.count_if(~missing & (F.col("_n") > 1)).alias("duplicated_ids"),
        F.sum(F.when(~missing & (F.col("_n") > 1), F.col("_n")).otherwise(0)).alias("duplicated_rows"))
    return totals.withColumn("is_unit", (F.col("missing") == 0) & (F.col("duplicated_ids") == 0))


def duplicated_rows(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The rows whose identifier occurs more than once, with the number of occurrences."""
    repeated = df.groupBy(*ids).agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1)
    return df.join(repeated, list(ids))


def value_types(df: DataFrame, columns: Sequence[str], expected: Mapping[str, Sequence[str]]) -> DataFrame:
    """What the values of text columns parse as, the family they imply and its agreement with the expectation."""
    # Patterns of the families.
    whole, boolean, day = r"^\s*[+-]?\d+\s*$", r"(?i)^\s*(true|false)\s*$", r"^\s*\d{4}-\d{2}-\d{2}\s*$"
    present = lambda c: F.col(c).isNotNull() & ~is_blank(c)
    counts = wide_rows(spread(df.select(*columns)), columns, {
        "row_count": lambda c: F.count(F.lit(1)), "present": lambda c: F.count_if(present(c)),
        "as_integer": lambda c: F.count_if(F.col(c).rlike(whole)),
        "as_number": lambda c: F.count_if(parse_number(c).isNotNull()),
        "as_boolean": lambda c: F.count_if(F.col(c).rlike(boolean)),
        "as_date": lambda c: F.count_if(F.col(c).rlike(day) & strip_text(c).try_cast("date").isNotNull())})
    all_are = lambda n: (F.col("present") > 0) & (F.col(n) == F.col("present"))
    family = (F.when(F.col("present") == 0, "any").when(all_are("as_integer"), "integer").when(all_are("as_number"), "floating")
              .when(all_are("as_boolean"), "boolean").when(all_are("as_date"), "datetime").otherwise("string"))
    # Families a wider expectation accepts.
    accepts = {"numeric": ("integer", "floating"), "object": ("string",), "categorical": ("string",),
               "any": ("any", "integer", "floating", "boolean", "datetime", "string")}
    status = F.lit("Not declared")
    for c, kinds in expected.items():
        good = sorted({f for k in kinds for f in accepts.get(k, (k,))})
        status = F.when(F.col("feature") == c, F.when(F.col("observed").isin(*good), "Match").otherwise("Mismatch")).otherwise(status)
    expected_text = F.lit("")
    for c, kinds in expected.items():
        expected_text = F.when(F.col("feature") == c, " | ".join(kinds)).otherwise(expected_text)
    rows = counts.withColumn("observed", family).withColumns({"expected": expected_text, "status": status})
    absent = [(c, *[0] * (len(counts.columns) - 1), "", " | ".join(k), "Missing column") for c, k in expected.items() if c not in columns]
    return rows.unionByName(df.sparkSession.createDataFrame(absent, rows.schema)) if absent else rows


def declared_types(df: DataFrame, expected: Mapping[str, Sequence[str]]) -> list[tuple[str, str, str, str]]:
    """(column, expected, observed type, status) from the schema alone; no job runs."""
    families = {
        "boolean": (T.BooleanType,), "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
        "floating": (T.FloatType, T.DoubleType), "numeric": (T.NumericType,), "string": (T.StringType,),
        "categorical": (T.StringType,), "object": (T.StringType,),
        "datetime": (T.DateType, T.TimestampType, T.TimestampNTZType), "timedelta": (T.DayTimeIntervalType,)}
    out = []
    for f in df.schema.fields:
        kinds = expected.get(f.name)
        name = f.dataType.simpleString()
        if kinds is None:
            out.append((f.name, "", name, "Not declared"))
            continue
        ok = any(k == "any" or k == name or isinstance(f.dataType, families.get(k, ())) for k in kinds)
        out.append((f.name, " | ".join(kinds), name, "Match" if ok else "Mismatch"))
    out += [(c, " | ".join(k), "", "Missing column") for c, k in expected.items() if c not in df.columns]
    return out


@dataclass(frozen=True)
class ValueRule:
    """What the values of one column must satisfy."""
    required: bool = True
    allow_blank: bool = False
    allowed: tuple | None = None
    numeric: bool = False
    integer: bool = False
    finite: bool = True
    minimum: float | None = None
    maximum: float | None = None
    strip: bool = True
    case_sensitive: bool = False


# Issue names in report order.
ISSUES = ("Inconsistent text", "Missing value", "Blank value", "Unexpected value", "Non-numeric value",
          "Non-finite value", "Non-integer value", "Below minimum", "Above maximum")


def with_numbers(df: DataFrame, rules: Mapping[str, ValueRule]) -> DataFrame:
    """Only the ruled columns, spread out, with `_num_<c>` parsed once for each numeric rule."""
    there = [c for c in rules if c in df.columns]
    number = lambda c: parse_number(c) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c).cast("double")
    return spread(df.select(*there)).withColumns({f"_num_{c}": number(c) for c in there if rules[c].numeric})


def issue_masks(df: DataFrame, c: str, rule: ValueRule) -> dict[str, Column]:
    """Boolean column per issue; a value that matches the allowed list only after normalising is inconsistent."""
    text = isinstance(df.schema[c].dataType, T.StringType)
    missing = is_missing(df, c)
    blank = is_blank(c) if text else F.lit(False)
    there = ~missing & ~blank
    masks: dict[str, Column] = {}
    if rule.required:
        masks["Missing value"] = missing
    if not rule.allow_blank:
        masks["Blank value"] = blank
    if rule.allowed is not None:
        exact = F.col(c).isin(*rule.allowed)
        alike = F.lit(False)
        if text:
            shape = lambda x: x if rule.case_sensitive else F.lower(x)
            fold = lambda v: v if rule.case_sensitive else v.lower()
            trim = strip_text(c) if rule.strip else F.col(c)
            alike = shape(trim).isin(*sorted({fold(str(v).strip() if rule.strip else str(v)) for v in rule.allowed}))
        masks["Inconsistent text"] = flag(there & ~exact & alike)
        masks["Unexpected value"] = flag(there & ~exact & ~alike)
    if rule.numeric:
        x = F.col(f"_num_{c}")
        number = there & x.isNotNull()
        masks["Non-numeric value"] = there & x.isNull()
        if rule.finite:
            masks["Non-finite value"] = flag(number & (F.abs(x) == float("inf")))
        if rule.integer:
            masks["Non-integer value"] = flag(number & (F.abs(x) != float("inf")) & (F.abs(x - F.floor(x)) > 1e-12))
        if rule.minimum is not None:
            masks["Below minimum"] = flag(number & (x < rule.minimum))
        if rule.maximum is not None:
            masks["Above maximum"] = flag(number & (x > rule.maximum))
    return {k: masks[k] for k in ISSUES if k in masks}


def _value_measures(df: DataFrame, rules: Mapping[str, ValueRule]) -> tuple[list[Column], list[dict[str, Column]]]:
    """Aggregates over rows of `with_numbers`, and the report rows that they become."""
    aggs, rows = [F.count(F.lit(1)).alias("row_count")], []
    for i, (c, rule) in enumerate(rules.items()):
        if c not in df.columns:
            zero = F.lit(0).cast("bigint")
            rows.append({"column": F.lit(c), "missing_count": zero, "blank_count": zero, "inconsistent_count": zero,
                         "invalid_count": zero, "affected_count": zero, "affected_percent": F.lit(0.0),
                         "issue_types": F.lit(""), "status": F.lit("Missing column")})
            continue
        masks = issue_masks(df, c, rule)
        invalid = any_of([m for k, m in masks.items() if k != "Inconsistent text"])
        text = isinstance(df.schema[c].dataType, T.StringType)
        aggs += [F.count_if(is_missing(df, c)).alias(f"_{i}_m"),
                 F.count_if(is_blank(c) if text else F.lit(False)).alias(f"_{i}_b"),
                 F.count_if(invalid).alias(f"_{i}_v"), F.count_if(any_of(list(masks.values()))).alias(f"_{i}_a")]
        aggs += [F.count_if(m).alias(f"_{i}_{k}") for k, m in masks.items()]
        n = lambda k: F.col(f"_{i}_{k}")
        rows.append({
            "column": F.lit(c), "missing_count": n("m"), "blank_count": n("b"),
            "inconsistent_count": n("Inconsistent text") if "Inconsistent text" in masks else F.lit(0).cast("bigint"),
            "invalid_count": n("v"), "affected_count": n("a"),
            "affected_percent": F.coalesce(F.round(100 * F.try_divide(n("a"), F.col("row_count")), 4), F.lit(0.0)),
            "issue_types": F.concat_ws(", ", *[F.when(n(k) > 0, F.lit(k)) for k in masks]),
            "status": F.when(n("a") > 0, "Review required").otherwise("Valid")})
    return aggs, rows


def value_checks(df: DataFrame, rules: Mapping[str, ValueRule]) -> DataFrame:
    """Missing, blank, inconsistent, invalid and affected rows of every ruled column in one scan."""
    df = with_numbers(df, rules)
    aggs, rows = _value_measures(df, rules)
    return rows_of(df.agg(*aggs), rows, keep=["row_count"])


class CheckFailed(ValueError):
    """A strict gate found issues; `report` has them as rows."""

    def __init__(self, report: DataFrame, columns: Sequence[str]):
        super().__init__(f"values to review in {', '.join(columns)}")
        self.report = report


def write_checked(df: DataFrame, path: str, rules: Mapping[str, ValueRule], strict: bool = False, mode: str = "errorifexists") -> DataFrame:
    """Write the rows as they are and check them in the same job; returns the rows of `value_checks`.

    The measures are observed while the rows pass to the files, so the input is read once, and a task that runs again
    counts once. The report is stored beside the table, in `path` + "-checks". Nothing is left out or changed: a strict
    gate that finds issues raises CheckFailed after both are written, so that the rows can be looked into. A ruled
    column that the table lacks is reported; an empty table has no issues.
    """
    names = df.columns
    number = lambda c: parse_number(c) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c).cast("double")
    numbers = {f"_num_{c}": number(c) for c, rule in rules.items() if rule.numeric and c in names}
    parsed = df.withColumns(numbers) if numbers else df
    aggs, rows = _value_measures(parsed, rules)
    seen = Observation()
    parsed.observe(seen, *aggs).select(*names).write.mode(mode).parquet(path)
    spark = df.sparkSession
    fields = ", ".join(f"`{k}` long" for k in seen.get)
    told = rows_of(spark.createDataFrame([tuple(seen.get.values())], fields), rows, keep=["row_count"])
    told.write.mode(mode).parquet(f"{path}-checks")
    report = spark.read.schema(told.schema).parquet(f"{path}-checks")
    if strict:
        bad = [r["column"] for r in report.where("status <> 'Valid'").orderBy("column").select("column").collect()]
        if bad:
            raise CheckFailed(report, bad)
    return report


def issue_samples(df: DataFrame, rules: Mapping[str, ValueRule], top: int = 5) -> DataFrame:
    """The `top` most frequent raw values per column and issue (count descending, then text).

    Values are counted before ranking, and the rank filter prunes every partition to its own top first.
    """
    df = with_numbers(df, rules)
    found = []
    for c, rule in rules.items():
        if c not in df.columns:
            continue
        for k, m in issue_masks(df, c, rule).items():
            value = F.lit("(missing)") if k == "Missing value" else to_text(c)
            found.append(F.when(m, F.struct(F.lit(c).alias("column"), F.lit(k).alias("issue"), value.alias("value"))))
    hits = df.select(F.explode(F.array_compact(F.array(*found))).alias("_i")).select("_i.*")
    counts = hits.groupBy("column", "issue", "value").agg(F.count(F.lit(1)).alias("count"))
    rank = Window.partitionBy("column", "issue").orderBy(F.col("count").desc(), "value")
    return counts.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)


def rules_from_source(metadata: Sequence[Mapping[str, str]], target: str | None = None,
                      classes: Sequence[str] = ()) -> dict[str, ValueRule]:
    """Value rules implied by a variable table (name, type): numbers must be numbers, integers whole."""
    rules = {}
    for row in metadata:
        kind = row["type"].strip().lower()
        if row["name"] == target and classes:
            rules[row["name"]] = ValueRule(allowed=tuple(classes))
        elif kind == "integer":
            rules[row["name"]] = ValueRule(numeric=True, integer=True)
        elif kind in ("continuous", "real", "numeric"):
            rules[row["name"]] = ValueRule(numeric=True)
        else:
            rules[row["name"]] = ValueRule()
    return rules


# --- domains and relations ---------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Domains:
    positive: tuple[str, ...] = ()
    non_negative: tuple[str, ...] = ()
    unit_interval: tuple[str, ...] = ()
    minimums: Mapping[str, float] = field(default_factory=dict)
    maximums: Mapping[str, float] = field(default_factory=dict)

    def rules(self) -> list[tuple[str, str, object]]:
        out = [(c, "> 0", lambda x: x > 0) for c in self.positive]
        out += [(c, ">= 0", lambda x: x >= 0) for c in self.non_negative]
        out += [(c, "0 <= value <= 1", lambda x: (x >= 0) & (x <= 1)) for c in self.unit_interval]
        out += [(c, f">= {b:g}", lambda x, b=b: x >= b) for c, b in self.minimums.items()]
        out += [(c, f"<= {b:g}", lambda x, b=b: x <= b) for c, b in self.maximums.items()]
        return out


def domain_checks(df: DataFrame, domains: Domains) -> DataFrame:
    """Observed range and violations per rule. NULLs are not judged; unreadable values are violations."""
    aggs, rows = [], []
    for i, (c, text, holds) in enumerate(domains.rules()):
        is_text = isinstance(df.schema[c].dataType, T.StringType)
        x = parse_number(c) if is_text else F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        judged = ~is_missing(df, c)
        bad = judged & ~flag(holds(x))
        aggs += [F.count_if(judged).alias(f"_{i}_n"), F.min(x).alias(f"_{i}_lo"), F.max(x).alias(f"_{i}_hi"),
                 F.count_if(bad).alias(f"_{i}_v")]
        rows.append({"column": F.lit(c), "rule": F.lit(text), "evaluated": F.col(f"_{i}_n"), "minimum": F.col(f"_{i}_lo"),
                     "maximum": F.col(f"_{i}_hi"), "violations": F.col(f"_{i}_v"),
                     "status": F.when(F.col(f"_{i}_v") > 0, "Violation").otherwise("Valid")})
    return rows_of(df.agg(*aggs), rows)


RELATIONS = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b,
             "==": lambda a, b: a == b}


def relation_checks(df: DataFrame, relations: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rows with both sides present and the rows that break the relation."""
    aggs, rows = [], []
    for i, (a, op, b) in enumerate(relations):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [F.count_if(both).alias(f"_{i}_n"), F.count_if(both & ~RELATIONS[op](F.col(a), F.col(b))).alias(f"_{i}_v")]
        rows.append({"relation": F.lit(f"{a} {op} {b}"), "evaluated": F.col(f"_{i}_n"), "violations": F.col(f"_{i}_v")})
    return rows_of(df.agg(*aggs), rows)


# --- duplicates ----------------------------------------------------------------------------------------------------

def duplicate_groups(df: DataFrame, columns: Sequence[str], position: str | None = None) -> DataFrame:
    """Groups of equal rows (NULLs equal) with their size and first position."""
    first = [F.min(position).alias("first_position")] if position else []
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("group_size"), *first).where(F.col("group_size") > 1)


def duplicate_samples(df: DataFrame, columns: Sequence[str], position: str, groups: int, rows_per_group: int) -> DataFrame:
    """The first rows of the first groups, groups numbered by their first position."""
    found = duplicate_groups(df, columns, position)
    chosen = found.orderBy("first_position").limit(groups)
    chosen = chosen.withColumn("group", F.row_number().over(Window.orderBy("first_position")))
    named = chosen.select(*[F.col(c).alias(f"_g_{c}") for c in columns], "group", "group_size")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in columns])
    members = df.join(F.broadcast(named), same).drop(*[f"_g_{c}" for c in columns])
    rank = Window.partitionBy("group").orderBy(position)
    return members.withColumn("member", F.row_number().over(rank)).where(F.col("member") <= rows_per_group)


def repeated_identifiers(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Identifiers seen more than once; identical or conflicting by their other columns."""
    rest = [c for c in df.columns if c not in ids]
    content = df.select(*ids, row_fingerprint(df, rest).alias("_h"))
    return content.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("group_size"), F.count_distinct("_h").alias("contents")).where(
        F.col("group_size") > 1).withColumn("kind", F.when(F.col("contents") > 1, "conflicting").otherwise("identical"))


def repeated_profiles(df: DataFrame, features: Sequence[str], target: str, ids: Sequence[str] = ()) -> DataFrame:
    """Feature profiles shared by several identifiers (or rows) and whether their targets agree; NULL is a target value."""
    tag = F.coalesce(to_text(target), F.lit("(missing)"))
    aggs = [F.count(F.lit(1)).alias("group_size"), F.count_distinct(tag).alias("targets")]
    wanted = F.col("group_size") > 1
    if ids:
        who = F.concat_ws("|", *[F.coalesce(to_text(c), F.lit("(missing)")) for c in ids])
        aggs.append(F.count_distinct(who).alias("identifiers"))
        wanted = wanted & (F.col("identifiers") > 1)
    return df.groupBy(*features).agg(*aggs).where(wanted).withColumn(
        "agreement", F.when(F.col("targets") > 1, "target conflict").otherwise("same target"))


def duplicate_summary(df: DataFrame, ids: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """Groups and rows by kind of repetition."""
    always = F.lit(True)

    def parts(groups: DataFrame, kinds: Sequence[tuple[str, Column]]) -> DataFrame:
        wide = groups.agg(*[x for i, (_, c) in enumerate(kinds) for x in (
            F.count_if(c).alias(f"_g{i}"), F.coalesce(F.sum(F.when(c, F.col("group_size"))), F.lit(0)).alias(f"_r{i}"))])
        return rows_of(wide, [{"metric": F.lit(n), "groups": F.col(f"_g{i}"), "rows": F.col(f"_r{i}")} for i, (n, _) in enumerate(kinds)])

    out = [parts(duplicate_groups(df, df.columns), [("exact rows", always)])]
    if ids:
        out.append(parts(repeated_identifiers(df, ids), [
            ("repeated identifiers", always), ("conflicting identifiers", F.col("kind") == "conflicting")]))
    agree = F.col("agreement")
    out.append(parts(repeated_profiles(df, features, target, ids), [
        ("repeated profiles", always), ("same-target profiles", agree == "same target"), ("target conflicts", agree == "target conflict")]))
    return reduce(DataFrame.unionByName, out)


# --- contracts, gate, findings -------------------------------------------------------------------------------------

def check_rows(wide: DataFrame, checks: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """(check, ok, detail) rows from one wide row."""
    return rows_of(wide, [{"check": F.lit(n), "ok": flag(ok), "detail": to_text(d)} for n, ok, d in checks])


# Declared kinds of a column and the Spark types that satisfy each.
COLUMN_KINDS = {"string": (T.StringType,), "integer": (T.IntegralType,), "numeric": (T.NumericType,), "boolean": (T.BooleanType,)}


def dataset_contract(df: DataFrame, columns: Sequence[str], ids: Sequence[str], target: str, classes: Sequence[str],
                     categories: Mapping[str, Sequence[str]] | None = None, kinds: Mapping[str, str] | None = None,
                     numeric_text: Sequence[str] = (), all_categories: bool = True) -> DataFrame:
    """Check table of a raw dataset: columns, order, types, identifier, target classes, categories.

    An identifier may be neither missing nor blank. Categories may be neither missing nor undeclared, and all declared
    ones have to be observed unless `all_categories` is off. `kinds` maps a column to string, integer, numeric or
    boolean; a text column in `numeric_text` is numeric where all its values that are not blank are numbers.
    """
    categories, kinds = categories or {}, kinds or {}
    missing = any_of([F.col(c).isNull() for c in ids])
    blank = any_of([is_blank(F.col(c).cast("string")) for c in ids])
    texts = [c for c in kinds if c in df.columns and kinds[c] == "numeric" and c in numeric_text and isinstance(df.schema[c].dataType, T.StringType)]
    by_id = df.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(flag(~F.col(target).isin(*classes)) | F.col(target).isNull()).alias("_t"),
        *[F.max(flag(F.col(target) == k)).alias(f"_k{i}") for i, k in enumerate(classes)],
        *[F.count_if(flag(~F.col(c).isin(*v))).alias(f"_c{i}") for i, (c, v) in enumerate(categories.items())],
        *[F.count_if(F.col(c).isNull()).alias(f"_cn{i}") for i, c in enumerate(categories)],
        *[F.max(flag(F.col(c) == x)).alias(f"_cs{i}_{k}") for i, (c, v) in enumerate(categories.items()) for k, x in enumerate(v)],
        *[F.count_if(F.col(c).isNotNull() & ~is_blank(c) & parse_number(c).isNull()).alias(f"_x{i}") for i, c in enumerate(texts)])
    wide = by_id.agg(
        F.sum(F.when(missing, F.col("_n")).otherwise(0)).alias("missing_ids"), F.sum(F.when(blank & ~missing, F.col("_n")).otherwise(0)).alias("blank_ids"),
        F.count_if(~missing & (F.col("_n") > 1)).alias("repeated_ids"), F.sum("_t").alias("bad_targets"),
        *[F.max(f"_k{i}").alias(f"_k{i}") for i in range(len(classes))],
        *[F.sum(f"_{k}{i}").alias(f"_{k}{i}") for i in range(len(categories)) for k in ("c", "cn")],
        *[F.max(f"_cs{i}_{k}").alias(f"_cs{i}_{k}") for i, v in enumerate(categories.values()) for k in range(len(v))],
        *[F.sum(f"_x{i}").alias(f"_x{i}") for i in range(len(texts))])
    absent = [c for c in columns if c not in df.columns]
    extra = [c for c in df.columns if c not in columns]
    count = lambda names: reduce(lambda a, b: a + b, [F.col(n).cast("bigint") for n in names], F.lit(0))
    seen = count([f"_k{i}" for i in range(len(classes))])
    wrong = sorted(c for c, kind in kinds.items() if c in df.columns and c not in texts and not isinstance(df.schema[c].dataType, COLUMN_KINDS[kind]))
    unread = count([f"_x{i}" for i in range(len(texts))])
    rows = [
        ("columns present", F.lit(not absent), F.lit(",".join(absent))),
        ("no extra columns", F.lit(not extra), F.lit(",".join(extra))),
        ("column order", F.lit(list(columns) == list(df.columns)), F.lit("")),
        ("column types", F.lit(not wrong), F.lit(",".join(wrong))),
        ("numeric text", unread == 0, unread),
        ("identifier complete", F.col("missing_ids") == 0, F.col("missing_ids")),
        ("identifier not blank", F.col("blank_ids") == 0, F.col("blank_ids")),
        ("identifier unique", F.col("repeated_ids") == 0, F.col("repeated_ids")),
        ("target values declared", F.col("bad_targets") == 0, F.col("bad_targets")),
        ("target classes observed", seen == len(classes), seen)]
    for i, (c, v) in enumerate(categories.items()):
        observed = count([f"_cs{i}_{k}" for k in range(len(v))])
        rows += [(f"categories of {c}", F.col(f"_c{i}") == 0, F.col(f"_c{i}")), (f"categories of {c} present", F.col(f"_cn{i}") == 0, F.col(f"_cn{i}"))]
        rows += [(f"categories of {c} observed", observed == len(v), observed)] if all_categories else []
    return check_rows(wide, rows)


def class_contract(df: DataFrame, target: str, classes: DataFrame) -> DataFrame:
    """Declared against observed classes: status per class. `classes` has one column `class`."""
    seen = df.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("rows"))
    declared = classes.select("class", F.lit(True).alias("_d"))
    both = seen.join(declared, seen["class"].eqNullSafe(declared["class"]), "full_outer")
    status = (F.when(seen["class"].isNull() & F.col("rows").isNotNull(), "missing value").when(F.col("_d").isNull(), "undeclared")
              .when(F.col("rows").isNull(), "unobserved").otherwise("agreed"))
    return both.select(F.coalesce(seen["class"], declared["class"], F.lit("(missing)")).alias("class"),
                       F.coalesce("rows", F.lit(0)).alias("rows"), status.alias("status"))


def numeric_target_contract(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Present, readable and finite counts of a continuous target and whether it varies."""
    x = F.col(target).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    ok = F.when(finite, x)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(x.isNull() | F.isnan(x)).alias("missing_count"),
        F.count_if(F.abs(x) == float("inf")).alias("non_finite_count"), F.count(ok).alias("finite_count"),
        (F.min(ok) < F.max(ok)).alias("varies")).withColumn(
        "satisfied", (F.col("missing_count") == 0) & (F.col("non_finite_count") == 0) & flag(F.col("varies")))


def failed(checks: DataFrame, strict: bool = False) -> DataFrame:
    """The failing checks. Strict mode makes the job fail on the first one instead of returning it."""
    bad = checks.where(~flag(F.col("ok")))
    if strict:
        message = F.concat(F.lit("check failed: "), F.col("check"), F.lit(" "), F.coalesce("detail", F.lit("")))
        bad = bad.withColumn("ok", F.raise_error(message).cast("boolean"))
    return bad


# Finding rules (id, severity, status, disposition, blocks). Support and outliers are never findings.
FINDINGS = {
    "type_or_domain": ("DQ-001", "High", "Open", "Must fix", "Preparation"),
    "value_quality": ("DQ-002", "High", "Open", "Must fix", "Preparation"),
    "identity": ("DQ-003", "High", "Open", "Must fix", "Preparation"),
    "exact_rows": ("DQ-003", "Medium", "Review", "Monitor", "None"),
    "target_conflict": ("DQ-004", "Medium", "Review", "Evaluate", "Model evaluation"),
    "target_contract": ("DQ-005", "Critical", "Open", "Must fix", "Modeling clearance"),
    "leakage": ("DQ-006", "Critical", "Open", "Prohibited", "Modeling clearance"),
    "dependency": ("DQ-007", "Medium", "Review", "Evaluate", "Model evaluation"),
}
# Clean outcomes (id, disposition, disposition with affected rows). Target conflicts have none.
NON_ISSUES = {
    "type_or_domain": ("NI-001", "No action", None), "value_quality": ("NI-002", "No action", None),
    "identity": ("NI-003", "Preserve", None), "exact_rows": ("NI-003", "Preserve", None),
    "target_contract": ("NI-004", "No action", None), "class_support": ("NI-005", "Monitor", "Monitor"),
    "target_extremes": ("NI-005", "Preserve", "Preserve"), "outliers": ("NI-006", "No action", "Preserve"),
    "leakage": ("NI-007", "No action", None), "dependency": ("NI-008", "Monitor", None), "no_dependency": ("NI-008", "No action", "No action"),
}
# Domain of each kind of report row.
DOMAINS = {
    "type_or_domain": "Schema and domain validity", "value_quality": "Value quality", "identity": "Record integrity", "exact_rows": "Record integrity",
    "target_conflict": "Record ambiguity", "target_contract": "Target integrity", "class_support": "Target support", "target_extremes": "Target distribution",
    "outliers": "Numerical distribution", "leakage": "Leakage governance", "dependency": "Derived-feature provenance", "no_dependency": "Derived-feature provenance",
}
# Order of severities.
SEVERITY_ORDER = {"Critical": 0, "High": 1, "Medium": 2, "Low": 3, "None": 4}


def consolidate_findings(evidence: DataFrame, known_fields: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Turn `(table_name, kind, affected, fields)` report rows of many tables into findings and clean outcomes.

    Rows of one table and kind are added up. A kind with nothing affected becomes a validated non-issue, target
    conflicts excepted, which then leave no row; class support, target extremes and outlier candidates are non-issues
    whatever is affected. `evidence` tells every report row as `fields: affected`. `known_fields`: the columns of each
    table; fields that are none of them stay in the evidence and are not named as affected.
    """
    named = F.col("affected") > 0
    if known_fields is not None:
        known = F.lit(False)
        for name, columns in known_fields.items():
            known = known | ((F.col("table_name") == name) & F.col("fields").isin(*columns))
        named = named & known
    summed = evidence.groupBy("table_name", "kind").agg(
        F.sum("affected").alias("affected"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(named, F.col("fields"))))).alias("affected_fields"),
        F.concat_ws("; ", F.array_sort(F.collect_list(F.concat("fields", F.lit(": "), F.col("affected").cast("string"))))).alias("evidence"))
    pick = lambda rules, i: F.create_map(*[x for k, v in rules.items() for x in (F.lit(k), F.lit(v[i]))])[F.col("kind")]
    some = F.col("affected") > 0
    bad = some & F.col("kind").isin(*FINDINGS)
    severity = F.when(bad, pick(FINDINGS, 1)).otherwise("None")
    order = F.create_map(*[x for k, v in SEVERITY_ORDER.items() for x in (F.lit(k), F.lit(v))])
    clean = F.when(some, pick(NON_ISSUES, 2)).otherwise(pick(NON_ISSUES, 1))
    return summed.where(some | F.col("kind").isin(*NON_ISSUES)).select(
        "table_name", "kind", F.create_map(*[x for k, v in DOMAINS.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")].alias("domain"),
        F.when(bad, pick(FINDINGS, 0)).otherwise(pick(NON_ISSUES, 0)).alias("finding_id"), severity.alias("severity"),
        F.when(bad, pick(FINDINGS, 2)).otherwise("Validated").alias("status"), F.when(bad, pick(FINDINGS, 3)).otherwise(clean).alias("disposition"),
        F.when(bad, pick(FINDINGS, 4)).otherwise("None").alias("blocks"), "affected", "affected_fields", "evidence",
        order[severity].cast("bigint").alias("severity_order"))


def readiness(findings: DataFrame) -> DataFrame:
    """Per table: findings by severity and whether preparation and modeling may go on."""
    blocked = lambda what: F.count_if(F.col("blocks") == what)
    return findings.groupBy("table_name").agg(
        F.count_if(F.col("severity") != "None").alias("findings"), F.count_if(F.col("severity") == "None").alias("non_issues"),
        F.count_if(F.col("severity") == "Critical").alias("critical"), F.count_if(F.col("severity") == "High").alias("high"),
        F.count_if(F.col("severity") == "Medium").alias("medium"),
        (blocked("Preparation") == 0).alias("ready_for_preparation"),
        ((blocked("Preparation") == 0) & (blocked("Modeling clearance") == 0)).alias("ready_for_modeling"))


def vocabulary(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct levels per column: `feature, level`, from the training rows only."""
    return train.select(*[to_text(c).alias(c) for c in columns]).unpivot([], list(columns), "feature", "level").where(
        F.col("level").isNotNull()).distinct()


def unknown_levels(train: DataFrame, scored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Levels of the scored rows absent from the training vocabulary with their row counts."""
    long = scored.select(*[to_text(c).alias(c) for c in columns]).unpivot([], list(columns), "feature", "level")
    counts = long.where(F.col("level").isNotNull()).groupBy("feature", "level").agg(F.count(F.lit(1)).alias("rows"))
    return counts.join(vocabulary(train, columns), ["feature", "level"], "left_anti")


def encode_long(train: DataFrame, df: DataFrame, keep: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """`keep…, feature, level` of every row and column whose level the training rows have; others have no row.

    The sparse form of a one-hot encoding, for columns with any number of levels: none becomes a column name.
    """
    long = df.select(*[F.col(k) for k in keep], *[to_text(c).alias(f"_l_{c}") for c in columns]).unpivot(
        list(keep), [f"_l_{c}" for c in columns], "feature", "level").withColumn("feature", F.substring("feature", 4, 1_000_000))
    return long.join(vocabulary(train, columns), ["feature", "level"]).select(*keep, "feature", "level")


def fit_levels(train: DataFrame, columns: Sequence[str], limit: int = 1000) -> dict[str, list[str]]:
    """Sorted training levels per column, for columns meant to be expanded; more than `limit` levels is an error.

    The one place where values reach the driver: they become column names.
    """
    rows = vocabulary(train, columns).limit(limit * len(columns) + 1).collect()
    out = {c: sorted(r["level"] for r in rows if r["feature"] == c) for c in columns}
    if len(rows) > limit * len(columns) or any(len(v) > limit for v in out.values()):
        raise ValueError(f"more than {limit} levels to expand")
    return out


def fit_encoding(train: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """One row of training means and population deviations."""
    return train.agg(*[F.avg(c).alias(f"_m_{c}") for c in numeric],
                     *[F.stddev_pop(c).alias(f"_s_{c}") for c in numeric])


def encode(df: DataFrame, fitted: DataFrame, keep: Sequence[str], numeric: Sequence[str],
           categorical: Mapping[str, Sequence[str]]) -> DataFrame:
    """Standardise with the fitted row (constant columns stay centred) and expand declared levels; unseen levels are all zero.

    The fitted side is a single aggregated row, so broadcasting it is bounded.
    """
    joined = df.join(F.broadcast(fitted))
    scale = lambda c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
    return joined.select(
        *keep, *[((F.col(c) - F.col(f"_m_{c}")) / scale(c)).alias(f"{c}_z") for c in numeric],
        *[flag(F.col(c) == v).cast("int").alias(f"{c}={v}") for c, vs in categorical.items() for v in vs])
