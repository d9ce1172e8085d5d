"""Event histories: snapshots with trailing windows, summaries, dense grids, yearly averages.

The event table is always aggregated before it meets the dimension, so one unit holding a large
share of the events costs one row per task in the shuffle.  Bounds of one row (reference date,
first and last year) are scalar subqueries, not joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.numbers import in_trailing_years, percentage
from panelspark.operators.keys import counter_entries


def reference_date(fact: DataFrame, date: str) -> Column:
    return fact.agg(F.max(date)).scalar()


def history_snapshot(dim: DataFrame, fact: DataFrame, unit: str, date: str, flag: str,
                     flag_name: str, sums: Sequence[str] = (), windows: Sequence[int] = (5, 10, 20),
                     reference: Column | None = None) -> DataFrame:
    """One row per unit of the dimension, also for units without events.

    The reference date is the latest event over all units.  Window counts take events strictly
    after the reference date minus n years.
    """
    ref = reference_date(fact, date) if reference is None else reference
    rows = fact.select(unit, date, flag, *sums).withColumn("__ref", ref)
    flagged = F.col(flag)
    inside = {n: in_trailing_years(F.col(date), F.col("__ref"), n) for n in windows}
    measures = [
        F.min(date).alias("first_event_date"), F.max(date).alias("latest_event_date"),
        F.count("*").alias("event_count"),
        F.count_if(flagged).alias(f"{flag_name}_event_count"),
        *[F.count_if(inside[n]).alias(f"event_count_{n}y") for n in windows],
        *[F.count_if(flagged & inside[n]).alias(f"{flag_name}_event_count_{n}y") for n in windows],
        *[F.sum(c).alias(c) for c in sums],
    ]
    per_unit = rows.groupBy(unit).agg(*measures)
    zero = [c for c in per_unit.columns if c not in (unit, "first_event_date", "latest_event_date")]
    return (dim.select(unit).join(per_unit, unit, "left")
            .withColumn("reference_date", ref)
            .select(unit, "reference_date", "first_event_date", "latest_event_date",
                    *[F.coalesce(F.col(c), F.lit(0).cast(per_unit.schema[c].dataType)).alias(c)
                      for c in zero]))


def type_summary(fact: DataFrame, keys: Sequence[str], date: str, sums: Sequence[str] = (),
                 carry: Sequence[str] = ()) -> DataFrame:
    """Observed unit x type pairs only; sums stay null when nothing was reported."""
    return fact.groupBy(*keys).agg(
        F.min(date).alias("first_event_date"), F.max(date).alias("latest_event_date"),
        F.count("*").alias("event_count"), *[F.sum(c).alias(c) for c in sums],
        *[F.min(c).alias(c) for c in carry])


def month_profile(dim: DataFrame, fact: DataFrame, unit: str, month: str, flag: str,
                  flag_name: str) -> DataFrame:
    """Dense unit x 12 months, zero where nothing happened."""
    flagged = f"{flag_name}_event_count"
    counts = fact.groupBy(unit, F.col(month).cast("int").alias("month")).agg(
        F.count("*").alias("event_count"), F.count_if(F.col(flag)).alias(flagged))
    # One row per unit meets the dimension; the twelve months are laid out after the join.
    per_unit = counts.filter("month IS NOT NULL").groupBy(unit).agg(F.map_from_entries(F.collect_list(F.struct(
        "month", F.struct("event_count", flagged)))).alias("__months"))
    grid = dim.select(unit).join(per_unit, unit, "left").withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    cell = F.try_element_at(F.col("__months"), F.col("month"))
    return grid.select(unit, "month", *[F.coalesce(cell[c], F.lit(0).cast("bigint")).alias(c) for c in ("event_count", flagged)])


def yearly_counts(fact: DataFrame, unit: str, year: str, type_column: str,
                  total_label=None) -> DataFrame:
    """Counts per unit, year and type plus the unit's total as type ``total_label``."""
    by_type = (fact.filter(F.col(year).isNotNull())
               .groupBy(unit, F.col(year).cast("int").alias("year"), F.col(type_column).alias("type"))
               .agg(F.count("*").alias("n")))
    both = F.explode(F.array(
        F.struct(F.col("type").alias("type"), F.col("n").alias("n")),
        F.struct(F.lit(total_label).cast(by_type.schema["type"].dataType).alias("type"),
                 F.col("n").alias("n"))))
    return (by_type.select(unit, "year", both.alias("e")).select(unit, "year", "e.type", "e.n")
            .groupBy(unit, "year", "type").agg(F.sum("n").alias("n")))


def region_yearly_average(dim: DataFrame, fact: DataFrame, unit: str, region: str, year: str,
                          type_column: str, types: Sequence, total_label) -> DataFrame:
    """Dense region x year x type averages over all members, those without events as zero.

    The year range is global over ``fact``; ``types`` lists every type except the total.
    """
    bounds = fact.agg(F.min(year).cast("int").alias("lo"), F.max(year).cast("int").alias("hi"))
    members = dim.groupBy(region).agg(F.count("*").alias("members"))
    counts = yearly_counts(fact, unit, year, type_column, total_label)
    totals = (counts.join(dim.select(unit, region), unit)
              .groupBy(region, "year", "type").agg(F.sum("n").alias("total")))
    labels = F.array(*[F.lit(t) for t in (total_label, *types)])
    grid = (members.withColumn("year", F.explode(F.sequence(
                bounds.select("lo").scalar(), bounds.select("hi").scalar())))
            .withColumn("type", F.explode(labels)))
    return (grid.join(totals, [region, "year", "type"], "left")
            .withColumn("total", F.coalesce("total", F.lit(0)))
            .withColumn("average", F.col("total") / F.col("members")))


def annual_series(dim: DataFrame, fact: DataFrame, unit: str, region: str, year: str,
                  type_column: str, types: Sequence, total_label) -> DataFrame:
    """Dense unit x year x type with the unit's own count and its region's average."""
    region_rows = region_yearly_average(dim, fact, unit, region, year, type_column, types, total_label)
    own = yearly_counts(fact, unit, year, type_column, total_label)
    # One row per unit and one per region meet; years and types are laid out after the joins.
    counts = own.groupBy(unit).agg(F.map_from_entries(F.collect_list(F.struct(
        F.struct("year", "type"), "n"))).alias("__counts"))
    cells = region_rows.groupBy(region).agg(F.collect_list(F.struct("year", "type", "average", "members")).alias("__cells"))
    grid = (dim.select(unit, region).join(counts, unit, "left").join(cells, region)
            .select(unit, region, "__counts", F.explode("__cells").alias("__cell")))
    count = F.try_element_at(F.col("__counts"), F.struct(F.col("__cell.year"), F.col("__cell.type")))
    return grid.select(region, "__cell.year", "__cell.type", unit, "__cell.average", "__cell.members",
                       F.coalesce(count, F.lit(0).cast("bigint")).alias("n"))


def type_breakdown(dim: DataFrame, by_type: DataFrame, unit: str, type_column: str,
                   catalogue: DataFrame, measures: Sequence[str], count: str = "event_count",
                   totals: DataFrame | None = None) -> DataFrame:
    """Every catalogue type for every unit, zero-filled, with its share of the unit's events.

    ``by_type`` may hold finer codes; they are merged per type (null sums count as zero).
    ``totals`` (unit, total) gives the denominators, else the sum over the types.  The share of a
    unit without events is 0 here, while ``month_breakdown`` gives null.
    """
    # Types as the catalogue writes them, so that a unit's map has each of them once.
    typed = by_type.withColumn(type_column, F.col(type_column).cast(catalogue.schema[type_column].dataType))
    observed = typed.groupBy(unit, type_column).agg(
        F.min("first_event_date").alias("first_event_date"),
        F.max("latest_event_date").alias("latest_event_date"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in measures])
    if totals is None:
        totals = observed.groupBy(unit).agg(F.sum(count).alias("total"))
    # One row per unit meets the dimension; the catalogue is laid out after the joins.
    fields = [c for c in observed.columns if c not in (unit, type_column)]
    per_unit = observed.filter(F.col(type_column).isNotNull()).groupBy(unit).agg(F.map_from_entries(F.collect_list(F.struct(
        type_column, F.struct(*fields)))).alias("__types"))
    entries = catalogue.agg(F.collect_list(F.struct(*catalogue.columns))).scalar()
    joined = (dim.select(unit).join(per_unit, unit, "left")
              .join(totals.select(unit, F.col("total").alias("__total")), unit, "left")
              .withColumn("__entry", F.explode(entries)))
    observation = F.try_element_at(F.col("__types"), F.col("__entry")[type_column])
    joined = joined.select(unit, *[F.col("__entry")[c].alias(c) for c in catalogue.columns],
                           *[observation[c].alias(c) for c in fields], "__total")
    filled = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in measures})
    share = F.coalesce(percentage(F.col(count), F.col("__total")), F.lit(0.0))
    return filled.withColumn("event_pct", share).drop("__total")


def month_breakdown(profile: DataFrame, unit: str, flagged: str) -> DataFrame:
    """Share of each month; null (not zero) for a unit without events.

    A unit has twelve rows, so a window per unit stays small.
    """
    total = F.sum(flagged).over(Window.partitionBy(unit))
    return profile.withColumn("event_pct", percentage(F.col(flagged), total))


def top_months(profile: DataFrame, unit: str, count: str, k: int = 3) -> DataFrame:
    """The k busiest months per unit (positive only, ties in month order) and their joint share.

    A unit has at most twelve rows here, so a window per unit stays small.
    """
    per_unit = Window.partitionBy(unit)
    ranked = (profile.withColumn("__total", F.sum(count).over(per_unit))
              .filter(F.col(count) > 0)
              .withColumn("position", F.row_number().over(per_unit.orderBy(F.desc(count), "month")))
              .filter(F.col("position") <= k))
    return ranked.withColumn("top_share_pct", percentage(
        F.sum(count).over(per_unit), F.col("__total"))).drop("__total")


def peak_year(counts: DataFrame, unit: str, year: str, n: str) -> DataFrame:
    """Year of the first maximum of each unit's series."""
    return counts.groupBy(unit).agg(
        F.max_by(F.col(year), F.struct(F.col(n), -F.col(year))).alias("peak_year"),
        F.max(n).alias("peak_count"))


def first_and_last(history: DataFrame, unit: str, year: str, value: str) -> DataFrame:
    return history.groupBy(unit).agg(
        F.min(year).alias("first_year"), F.min_by(value, year).alias("first_value"),
        F.max(year).alias("latest_year"), F.max_by(value, year).alias("latest_value"))


def scale_to_max(counts: DataFrame, unit: str, n: str) -> DataFrame:
    """Each value of a unit's yearly series as a percentage of its largest, at least 1."""
    top = F.greatest(F.max(n).over(Window.partitionBy(unit)), F.lit(1))
    return counts.withColumn("scaled_pct", F.col(n) / top * 100.0)


def event_rollup(rows: DataFrame, unit: str, year: str, type_label: str, recognized: Column,
                 sums: dict[str, Column]) -> DataFrame:
    """Per unit: records, recognised, first and last year, impact sums, type and year counters."""
    base = rows.groupBy(unit).agg(
        F.count("*").alias("records"), F.count_if(recognized).alias("recognized"),
        F.min(year).alias("first_year"), F.max(year).alias("last_year"),
        *[F.sum(c).alias(name) for name, c in sums.items()])
    return (base.join(counter_entries(rows, [unit], type_label, "types"), unit, "left")
            .join(counter_entries(rows, [unit], year, "years", by_count=False), unit, "left"))


def monetary_reference(factors: DataFrame) -> DataFrame:
    """Latest year whose correction factor is 1 with its index; an error when there is none."""
    best = factors.filter(F.col("correction_factor") == 1).agg(
        F.max_by(F.struct("reference_year", "igp_di_december_index"),
                 "reference_year").alias("best"))
    index = F.col("best.igp_di_december_index")
    return best.select(
        F.col("best.reference_year").alias("reference_year"),
        F.when(index.isNotNull(), index).otherwise(
            F.raise_error(F.lit("no monetary reference year in the factors"))).alias("index"))
