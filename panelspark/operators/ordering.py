"""Exact ranks, running totals and quantiles that do not need a large group in one task.

A plain ``Window.partitionBy(group).orderBy(value)`` and the builtin exact ``percentile`` both
put a group into a single task.  Here rows are dealt by ranges of (group, value), whatever the size
of a group; every range is totalled by itself, and the totals of a group's earlier ranges give each
range its offset.  Where the ranges are cut only decides how work is spread, never a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelspark.session import cut_lineage


def running_totals(df: DataFrame, group: Sequence[str], order: str, weight: str,
                   ranges: int | None = None) -> DataFrame:
    """Add ``before`` (weight of all smaller ``order`` values) and ``total`` per group.

    ``df`` has one row per (group, order) and a non-null ``order``.  ``ranges`` is the number of
    ranges (the session's shuffle partitions if not given).  A range is known by the partition it
    lands in, so the dealt rows are materialised once.
    """
    group = list(group)
    dealt = (df.repartitionByRange(ranges, *group, order) if ranges else df.repartitionByRange(*group, order))
    placed = cut_lineage(dealt.withColumn("__range", F.spark_partition_id()))
    span = [*group, "__range"]
    inside = Window.partitionBy(*span).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("__local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    # At most one row per range and group from here on.
    whole = Window.partitionBy(*(group or [F.lit(1)]))
    across = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*span).agg(F.sum(weight).alias("__weight")).select(
        *span, F.coalesce(F.sum("__weight").over(across), F.lit(0)).alias("__offset"),
        F.sum("__weight").over(whole).alias("total"))
    named = offsets.withColumnsRenamed({c: f"__of_{c}" for c in span})
    same = F.col("__range") == F.col("__of___range")
    for column in group:
        same = same & F.col(column).eqNullSafe(F.col(f"__of_{column}"))
    return (local.join(named, same).withColumn("before", F.col("__local") + F.col("__offset"))
            .drop("__local", "__offset", "__range", *[f"__of_{c}" for c in span]))


def value_counts(df: DataFrame, group: Sequence[str], value: str, **spread) -> DataFrame:
    """Distinct values per group with ``n``, ``before`` (rows strictly lower) and ``total``."""
    counted = (df.filter(F.col(value).isNotNull()).groupBy(*group, value)
               .agg(F.count("*").alias("n")))
    return running_totals(counted, group, value, "n", **spread)


def quantiles_from_counts(counts: DataFrame, group: Sequence[str], value: str,
                          probs: dict[str, float], *extra) -> DataFrame:
    """Continuous (interpolated) quantiles per group out of ``value_counts`` rows."""
    last = F.col("before") + F.col("n") - 1
    picks, finals = [], []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("total") - 1)
        for side, index in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            here = (F.col("before") <= index) & (index <= last)
            picks.append(F.max(F.when(here, F.col(value))).alias(f"__{name}_{side}"))
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        position = F.lit(float(p)) * (F.col("__total") - 1)
        finals.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    rolled = counts.groupBy(*group).agg(F.max("total").alias("__total"), *picks, *extra)
    kept = [c for c in rolled.columns if not c.startswith("__")]
    return rolled.select(*kept, *finals)


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float],
                    **spread) -> DataFrame:
    return quantiles_from_counts(value_counts(df, group, value, **spread), group, value, probs)
