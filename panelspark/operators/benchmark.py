"""Comparison of each unit with its peer group, keeping missing, undefined and zero apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.operators.ordering import quantiles_from_counts, value_counts
from panelspark.session import cut_lineage

INCLUDED, MISSING, UNDEFINED = "included", "missing", "undefined"


def metric_rows(df: DataFrame, unit: str, group: str, metrics: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Long form: one row per unit and metric with ``value`` and ``state``.

    ``metrics`` maps a metric name to its value and state columns.
    """
    entries = F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"), state.alias("state"))
        for name, (value, state) in metrics.items()]))
    return df.select(unit, group, entries.alias("m")).select(unit, group, "m.metric", "m.value", "m.state")


def peer_benchmark(rows: DataFrame, unit: str, group: str, **spread) -> DataFrame:
    """Group mean, median and denominators plus the unit's share of strictly lower peers.

    Only included values enter mean, median and ranks; the unit itself is part of the
    denominator.  A unit that is not included has no position.

    Rows are reduced to distinct values per group before anything is ranked, so a group holding
    most units, or one value held by most of them, is no large task.  One row per unit and metric
    is materialised because it is read twice.
    """
    keys = [group, "metric"]
    rows = cut_lineage(rows)
    included = F.col("state") == INCLUDED
    value = F.when(included, F.col("value"))
    summary = rows.groupBy(*keys).agg(
        F.count("*").alias("group_size"), F.avg(value).alias("mean"),
        *[F.count_if(F.col("state") == s).alias(s) for s in (INCLUDED, MISSING, UNDEFINED)])
    ranks = value_counts(rows.filter(included), keys, "value", **spread)
    medians = quantiles_from_counts(ranks, keys, "value", {"median": 0.5})
    position = ranks.select(*keys, F.col("value").alias("__value"),
                            (F.col("before") / F.col("total") * 100.0).alias("pct_strictly_lower"))
    placed = rows.withColumn("__value", value).join(position, [*keys, "__value"], "left").drop("__value")
    return placed.join(summary.join(medians, keys, "left"), keys)


def panel_metric_states(dim: DataFrame, history: DataFrame, change: DataFrame, unit: str,
                        share_columns: Sequence[str], change_columns: dict[str, str],
                        reference_column: str, mapped: str = "mapped_area_ha") -> DataFrame:
    """Value and state of each panel metric for every unit of the dimension.

    Shares use the unit's own latest year.  A change needs a change row with a reference year, a
    row of the unit in that year with a non-zero base, a non-zero mapped area and a value.
    ``change_columns`` maps a change column to the history column holding its base.
    """
    latest = history.groupBy(unit).agg(
        F.max("year").alias("latest_snapshot_year"),
        *[F.max_by(c, "year").alias(c) for c in (mapped, *share_columns)])
    wanted = change.select(unit, reference_column, *change_columns)
    bases = sorted(set(change_columns.values()))
    baseline = history.join(
        wanted.select(unit, F.col(reference_column).alias("year")), [unit, "year"]
    ).select(unit, *[F.col(c).alias(f"base_{c}") for c in bases])
    joined = (dim.join(latest, unit, "left").join(wanted, unit, "left").join(baseline, unit, "left"))
    no_area = F.coalesce(F.col(mapped), F.lit(0.0)) == 0
    missing = F.col("latest_snapshot_year").isNull()
    out = {}
    for column in share_columns:
        undefined = no_area | F.col(column).isNull()
        out[column] = F.when(missing, MISSING).when(undefined, UNDEFINED).otherwise(INCLUDED)
    for column, base in change_columns.items():
        undefined = (F.col(reference_column).isNull() | no_area | F.col(column).isNull()
                     | (F.coalesce(F.col(f"base_{base}"), F.lit(0.0)) == 0))
        out[column] = F.when(missing, MISSING).when(undefined, UNDEFINED).otherwise(INCLUDED)
    states = joined.withColumns({f"{c}_state": s for c, s in out.items()})
    return states.withColumns({c: F.when(F.col(f"{c}_state") == INCLUDED, F.col(c)) for c in out})
