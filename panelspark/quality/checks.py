"""Data-quality checks as aggregates.

All row-level checks of a table share one pass: ``aggregate_checks`` folds their counters into a
single ``agg``.  Checks that need grouping or a second table are one-row DataFrames judged by
``judge``.  Either way the result has the columns table, name, status, observed, expected.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.text import full_match
from panelspark.operators.keys import (dependency_violations, duplicate_keys, key_comparison_counts,
                                       mismatch_counts, only_in_left)
from panelspark.operators.ordering import exact_quantiles

PASS, FAIL, NOT_RUN = "PASS", "FAIL", "NOT_RUN"
RESULT_COLUMNS = ("table", "name", "status", "observed", "expected")


@dataclass(frozen=True)
class Check:
    """Named counters with their expected values.

    ``passed`` takes the counters as columns; without it every counter must equal its expected
    value.
    """

    name: str
    observed: dict[str, Column]
    expected: dict | str
    passed: Callable[[dict[str, Column]], Column] | None = None


def _verdict(check: Check, columns: dict[str, Column]) -> Column:
    if check.passed is not None:
        return F.coalesce(check.passed(columns), F.lit(False))
    return reduce(lambda a, b: a & b, [columns[k].eqNullSafe(F.lit(v))
                                       for k, v in check.expected.items()], F.lit(True))


def _result(table: str, check: Check, columns: dict[str, Column]) -> Column:
    expected = check.expected if isinstance(check.expected, str) else json.dumps(
        check.expected, ensure_ascii=False, separators=(",", ":"))
    return F.struct(
        F.lit(table).alias("table"), F.lit(check.name).alias("name"),
        F.when(_verdict(check, columns), PASS).otherwise(FAIL).alias("status"),
        F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]),
                  {"ignoreNullFields": "false"}).alias("observed"),
        F.lit(expected).alias("expected"))


def aggregate_checks(df: DataFrame, table: str, checks: Sequence[Check]) -> DataFrame:
    """All checks of one table in one aggregation."""
    names = {(i, k): f"c{i}_{j}" for i, c in enumerate(checks) for j, k in enumerate(c.observed)}
    row = df.agg(*[checks[i].observed[k].alias(alias) for (i, k), alias in names.items()])
    results = [_result(table, c, {k: F.col(names[i, k]) for k in c.observed})
               for i, c in enumerate(checks)]
    return row.select(F.explode(F.array(*results)).alias("r")).select("r.*")


def judge(row: DataFrame, table: str, name: str, expected: dict | str,
          passed: Callable[[dict[str, Column]], Column] | None = None) -> DataFrame:
    """A check over an already computed one-row DataFrame."""
    columns = {c: F.col(c) for c in row.columns}
    return row.select(_result(table, Check(name, columns, expected, passed), columns).alias("r")).select("r.*")


def not_run(spark, table: str, name: str, reason: str) -> DataFrame:
    """A row that says a check was left out, and why; it does not stop a run."""
    return spark.range(1).select(F.lit(table).alias("table"), F.lit(name).alias("name"), F.lit(NOT_RUN).alias("status"),
                                 F.to_json(F.struct(F.lit(reason).alias("reason"))).alias("observed"), F.lit("run").alias("expected"))


def union_checks(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


# Row-level checks -----------------------------------------------------------------------------

def row_count(expected: int, name: str = "row_count") -> Check:
    return Check(name, {"rows": F.count("*")}, {"rows": expected})


def not_null(columns: Sequence[str], blank_is_null: Sequence[str] = (), name: str = "not_null") -> Check:
    def absent(c):
        return F.coalesce(F.col(c), F.lit("")) == "" if c in blank_is_null else F.col(c).isNull()

    return Check(name, {c: F.count_if(absent(c)) for c in columns}, {c: 0 for c in columns})


def rule(name: str, violation: Column) -> Check:
    return Check(name, {"violations": F.count_if(violation)}, {"violations": 0})


def rules(name: str, violations: dict[str, Column]) -> Check:
    return Check(name, {k: F.count_if(v) for k, v in violations.items()}, {k: 0 for k in violations})


def matches(patterns: dict[str, str], name: str = "code_shapes",
            conflicts: dict[str, Column] | None = None) -> Check:
    """Whole-value patterns per column, plus conflicts between columns (for example a prefix)."""
    violations = {f"invalid_{c}": ~full_match(F.col(c), p) for c, p in patterns.items()}
    return rules(name, {**violations, **(conflicts or {})})


def non_negative(columns: Sequence[str], name: str = "non_negative") -> Check:
    return rules(name, {c: F.col(c) < 0 for c in columns})


def row_identity(totals: dict[str, Sequence[str]], tolerance: float | None = None,
                 name: str = "row_identity") -> Check:
    """Each total equals the sum of its parts, exactly or within a tolerance."""
    violations = {}
    for total, parts in totals.items():
        expected = reduce(lambda a, b: a + b, [F.col(p) for p in parts])
        violations[total] = (F.col(total) != expected if tolerance is None else
                             F.abs(F.col(total) - expected) > F.lit(tolerance).cast("decimal(10,4)"))
    return rules(name, violations)


def bounded(columns: Sequence[str], low: float, high: float, tolerance: float = 0.0,
            name: str = "bounded") -> Check:
    return rules(name, {c: (F.col(c) < low - tolerance) | (F.col(c) > high + tolerance) for c in columns})


def allowed_values(columns: Sequence[str], allowed: Sequence, name: str = "allowed_values") -> Check:
    return rules(name, {c: ~F.col(c).isin(*allowed) for c in columns})


def expected_counts(counts: dict[str, tuple[Column, int]], name: str = "expected_counts") -> Check:
    return Check(name, {k: F.count_if(c) for k, (c, _) in counts.items()},
                 {k: n for k, (_, n) in counts.items()})


def derived_dates(date: str, year: str, month: str, first_year: int, latest_year: int,
                  name: str = "derived_dates") -> Check:
    """Year and month columns agree with the date and the declared bounds."""
    return Check(name, {
        "first_year": F.min(year), "latest_year": F.max(year),
        "event_year_differences": F.count_if(F.col(year) != F.year(date)),
        "event_month_differences": F.count_if(F.col(month) != F.month(date)),
        "invalid_months": F.count_if(~F.col(month).between(1, 12)),
    }, {"first_year": first_year, "latest_year": latest_year, "event_year_differences": 0,
        "event_month_differences": 0, "invalid_months": 0})


def series_complete(year: str, first: int, last: int, name: str = "series_complete") -> Check:
    """Every year of the range occurs; the gaps are listed."""
    years = F.sequence(F.lit(first), F.lit(last))
    gaps = F.array_except(years, F.collect_set(F.col(year).cast("int")))
    return Check(name, {"min_year": F.min(year), "max_year": F.max(year),
                        "year_count": F.countDistinct(year), "gaps": gaps},
                 {"min_year": first, "max_year": last, "year_count": last - first + 1, "gaps": []},
                 lambda c: (c["min_year"] == first) & (c["max_year"] == last)
                 & (c["year_count"] == last - first + 1) & (F.size(c["gaps"]) == 0))


# Grouping and two-table checks: one-row DataFrames ---------------------------------------------

def unique(df: DataFrame, table: str, keys: Sequence[str], name: str) -> DataFrame:
    row = duplicate_keys(df, keys).agg(F.count("*").alias("duplicate_keys"))
    return judge(row, table, name, {"duplicate_keys": 0})


def functional_dependency(df: DataFrame, table: str, key: Sequence[str], dependent: Sequence[str],
                          name: str) -> DataFrame:
    row = dependency_violations(df, key, dependent).agg(F.count("*").alias("violations"))
    return judge(row, table, name, {"violations": 0})


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], table: str, name: str) -> DataFrame:
    row = key_comparison_counts(left, right, keys).select(
        F.col("left_only").alias("missing_count"), F.col("right_only").alias("unexpected_count"))
    return judge(row, table, name, {"missing_count": 0, "unexpected_count": 0})


def contains_keys(df: DataFrame, table: str, key: str, wanted: Sequence, name: str) -> DataFrame:
    row = df.filter(F.col(key).isin(*wanted)).agg(F.countDistinct(key).alias("found"))
    return judge(row, table, name, {"found": len(set(wanted))})


def dimension_agrees(fact: DataFrame, dim: DataFrame, key: str, pairs: dict[str, str], table: str,
                     name: str) -> DataFrame:
    """Fact codes missing from the dimension and fact columns that contradict it.

    The fact is first reduced to its distinct combinations with a row count.
    """
    combos = fact.groupBy(key, *pairs).agg(F.count("*").alias("__n"))
    side = dim.select(key, F.lit(True).alias("__hit"),
                      *[F.col(d).alias(f"__{d}") for d in dict.fromkeys(pairs.values())])
    conflict = reduce(lambda a, b: a | b, [F.col(f) != F.col(f"__{d}") for f, d in pairs.items()])
    missing = F.col("__hit").isNull()
    row = combos.join(side, key, "left").agg(
        F.coalesce(F.sum(F.when(missing, F.col("__n"))), F.lit(0)).alias("missing_codes"),
        F.coalesce(F.sum(F.when(~missing & conflict, F.col("__n"))), F.lit(0)).alias("mapping_conflicts"))
    return judge(row, table, name, {"missing_codes": 0, "mapping_conflicts": 0})


def side_by_side(spark, measures: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """One row with one aggregate per table, as scalar subqueries."""
    return spark.range(1).select(*[
        df.agg(measure.alias("v")).scalar().alias(label) for label, (df, measure) in measures.items()])


def counts_reconcile(spark, measures: dict[str, tuple[DataFrame, Column]], groups: Sequence[Sequence[str]],
                     table: str, name: str) -> DataFrame:
    """Aggregates of several tables, where each group of labels must agree."""
    row = side_by_side(spark, measures)

    def agree(columns):
        equal = [columns[g[0]].eqNullSafe(columns[x]) for g in groups for x in g[1:]]
        return reduce(lambda a, b: a & b, equal)

    return judge(row, table, name, "equal: " + "; ".join(" = ".join(g) for g in groups), agree)


def coverage(fact: DataFrame, dim: DataFrame, key: str, threshold_pct: float, table: str,
             name: str) -> DataFrame:
    """Share of dimension units present in the fact."""
    row = key_comparison_counts(fact, dim, [key]).withColumn(
        "coverage_pct", F.col("matched_keys") / F.nullif(F.col("right_keys"), F.lit(0)) * 100.0)
    return judge(row, table, name, f"coverage_pct >= {threshold_pct}",
                 lambda c: c["coverage_pct"] >= threshold_pct)


def rollup_differences(fine: DataFrame, coarse: DataFrame, keys: Sequence[str], measure: str,
                       tolerance: float) -> DataFrame:
    """Keys where the sum of the fine rows differs from the coarse row, either side absent as 0."""
    summed = fine.groupBy(*keys).agg(F.sum(measure).alias("__fine"))
    joined = summed.join(coarse.select(*keys, F.col(measure).alias("__coarse")), list(keys), "full")
    gap = F.abs(F.coalesce(F.col("__fine"), F.lit(0)) - F.coalesce(F.col("__coarse"), F.lit(0)))
    return joined.filter(gap > tolerance)


def rollup_agrees(fine: DataFrame, coarse: DataFrame, keys: Sequence[str], measure: str,
                  tolerance: float, table: str, name: str) -> DataFrame:
    row = rollup_differences(fine, coarse, keys, measure, tolerance).agg(
        F.count("*").alias("aggregation_differences"))
    return judge(row, table, name, {"aggregation_differences": 0})


def variation(df: DataFrame, unit: str, measure: str) -> DataFrame:
    """Relative range of a measure per unit over its series, in percent of the mean."""
    spread = F.max(measure) - F.min(measure)
    return df.groupBy(unit).agg(
        F.min(measure).alias("min_value"), F.max(measure).alias("max_value"),
        (spread / F.nullif(F.avg(measure), F.lit(0)) * 100.0).alias("variation_pct"))


def stable_over_time(df: DataFrame, unit: str, measure: str, warn_pct: float, fail_pct: float,
                     table: str, name: str) -> DataFrame:
    per_unit = variation(df, unit, measure)
    probs = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    quantiles = exact_quantiles(per_unit, [], "variation_pct", probs)
    row = per_unit.agg(
        F.count_if(F.col("min_value") <= 0).alias("nonpositive_rows"),
        F.count_if(F.col("variation_pct") > warn_pct).alias("over_warning_threshold"),
        F.count_if(F.col("variation_pct") > fail_pct).alias("over_failure_threshold"),
        F.max("variation_pct").alias("max_variation_pct"))
    row = row.withColumns({p: quantiles.select(p).scalar() for p in probs})
    return judge(row, table, name, {"nonpositive_rows": 0, "over_failure_threshold": 0})


def largest_variations(df: DataFrame, unit: str, measure: str, k: int = 20) -> DataFrame:
    return variation(df, unit, measure).orderBy(F.desc_nulls_last("variation_pct"), unit).limit(k)


def typed_copy_agrees(compared: DataFrame, table: str, name: str) -> DataFrame:
    row = mismatch_counts(compared).select("compared_rows", "differing_rows")
    return judge(row, table, name, {"differing_rows": 0})


def subset(left: DataFrame, right: DataFrame, keys: Sequence[str], table: str, name: str) -> DataFrame:
    row = only_in_left(left, right, keys).agg(F.count("*").alias("outside"))
    return judge(row, table, name, {"outside": 0})


def non_empty(inventory: DataFrame, table: str, name: str = "files_are_not_empty") -> DataFrame:
    row = inventory.agg(F.count("*").alias("files"),
                        F.count_if(F.col("content_length") <= 0).alias("empty_files"))
    return judge(row, table, name, "files > 0, empty_files = 0",
                 lambda c: (c["files"] > 0) & (c["empty_files"] == 0))


def status_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def anomaly_report(df: DataFrame, flags: dict[str, Column], natural_key: Sequence[str], unit: str,
                   name_column: str) -> DataFrame:
    """Counts that are reported but never fail: flags, natural-key repeats, name variants."""
    groups = duplicate_keys(df, natural_key).agg(F.count("*").alias("v"))
    variants = (df.filter(F.col(name_column).isNotNull()).select(unit, name_column).distinct()
                .groupBy(unit).count().filter("count > 1").agg(F.count("*").alias("v")))
    return df.agg(*[F.count_if(c).alias(k) for k, c in flags.items()]).withColumns({
        "natural_key_duplicate_groups": groups.scalar(),
        "codes_with_name_variants": variants.scalar()})


def warnings_from(row: DataFrame, texts: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Conditional warning rows: name to (condition, text) over a one-row DataFrame."""
    entries = F.array(*[F.when(condition, F.struct(F.lit(name).alias("name"), text.alias("text")))
                        for name, (condition, text) in texts.items()])
    return row.select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("w")).select("w.*")


class QualityFailure(RuntimeError):
    """At least one check failed; nothing may be published."""


def overall_status(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.when(F.count_if(F.col("status") == FAIL) == 0, PASS).otherwise(FAIL).alias("status"),
        F.count("*").alias("checks"), F.count_if(F.col("status") == FAIL).alias("failed"))


def gate(checks: DataFrame) -> None:
    """Stop the run when a check failed.  There is one row per named check, so it is collected."""
    failed = [r["name"] for r in checks.filter(F.col("status") == FAIL).select("name").collect()]
    if failed:
        raise QualityFailure("quality checks failed: " + ", ".join(sorted(failed)))
