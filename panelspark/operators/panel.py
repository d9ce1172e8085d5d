"""Wide yearly panels: melt, class semantics, roll-ups and multi-horizon change."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.numbers import area_km2, pct_change, percentage
from panelspark.operators.keys import dependency_violations, duplicate_keys, full_outer_with_flags
from panelspark.presets import panel as pn
from panelspark.sources.contracts import ContractError, with_lineage


def melt_panel(wide: DataFrame, ids: Sequence[str], year_columns: Sequence[str], value: str,
               year: str = "year", year_prefix: str = "y") -> DataFrame:
    """Year columns to rows; cells without a value give no row."""
    long = wide.unpivot(list(ids), list(year_columns), "__year", value)
    return (long.filter(F.col(value).isNotNull())
            .withColumn(year, F.substring("__year", len(year_prefix) + 1, 4).cast("int"))
            .select(*ids, year, value))


@dataclass(frozen=True)
class ClassSemantics:
    """Class ids of each indicator, resolved from official names and hierarchy branches."""

    named: dict[str, int]
    branches: dict[str, tuple[int, ...]]
    not_observed: tuple[int, ...]
    mapped: tuple[int, ...]
    in_source: tuple[int, ...]


def class_hierarchy(wide: DataFrame, class_column: str = "class",
                    levels: Sequence[str] = ("class_level_0", "class_level_1", "class_level_2",
                                             "class_level_3", "class_level_4")) -> DataFrame:
    """Distinct class rows of the panel; a class with two hierarchies is an error.

    The result has one row per class of the classification, whatever the panel's size.
    """
    distinct = wide.groupBy(F.col(class_column).cast("int").alias("class_id"), *levels).agg(
        F.count("*").alias("rows"))
    if not dependency_violations(distinct, ["class_id"], levels).isEmpty():
        raise ContractError("a class has more than one hierarchy")
    return distinct.select("class_id", *[F.col(c).alias(f"{c}_name") for c in levels])


def indicator_classes(hierarchy: DataFrame, legend: DataFrame, names: dict[str, str] = pn.CLASS_NAMES,
                      branches: dict[str, tuple[str, ...]] = pn.BRANCHES,
                      not_observed: str = pn.NOT_OBSERVED) -> DataFrame:
    """(indicator, class_id): classes by legend name, by branch, not observed, and mapped.

    Names are compared case-blind with the legend, branches with the first level of the hierarchy.
    """
    listed = lambda pairs: F.array(*[F.struct(F.lit(k).alias("indicator"), F.lit(v).alias("wanted")) for k, v in pairs])
    hidden = F.coalesce(F.col("class_level_1_name").rlike(f"(?i){not_observed}"), F.lit(False))
    named = (legend.select("class_id", F.lower("class_name_pt_br").alias("__name"),
                           F.explode(listed([(k, n.lower()) for k, n in names.items()])).alias("e"))
             .filter(F.col("__name") == F.col("e.wanted")))
    inside = (hierarchy.select("class_id", F.col("class_level_1_name").alias("__name"),
                               F.explode(listed([(k, b) for k, group in branches.items() for b in group])).alias("e"))
              .filter(F.col("__name") == F.col("e.wanted")))
    seen = hierarchy.select(F.when(hidden, "not_observed").otherwise("mapped").alias("indicator"), "class_id")
    pick = lambda df: df.select("e.indicator", "class_id")
    return pick(named).unionByName(pick(inside)).unionByName(seen)


def class_semantics(hierarchy: DataFrame, legend: DataFrame,
                    names: dict[str, str] = pn.CLASS_NAMES,
                    branches: dict[str, tuple[str, ...]] = pn.BRANCHES,
                    not_observed: str = pn.NOT_OBSERVED,
                    documented: dict[str, int] | None = None) -> ClassSemantics:
    """Resolve indicator classes; both inputs hold one row per class, so they are collected.

    Each name must match exactly one legend row (case-blind), each branch must exist, each named
    class must occur in the statistics, and documented ids must agree with the legend.
    """
    if not duplicate_keys(legend, ["class_id"]).isEmpty():
        raise ContractError("the legend has a duplicate class_id")
    flags = [F.lower("class_name_pt_br").eqNullSafe(F.lower(F.lit(n))).alias(k)
             for k, n in names.items()]
    legend_rows = legend.select("class_id", *flags).collect()
    named = {}
    for key, name in names.items():
        matches = [row["class_id"] for row in legend_rows if row[key]]
        if len(matches) != 1:
            raise ContractError(f"expected one class named {name!r}, found {len(matches)}")
        named[key] = matches[0]
    for key, class_id in (documented or {}).items():
        if named[key] != class_id:
            raise ContractError(f"legend and documentation disagree on the {key} class")

    rows = hierarchy.select(
        "class_id", F.col("class_level_1_name").alias("branch"),
        F.coalesce(F.col("class_level_1_name").rlike(f"(?i){not_observed}"), F.lit(False))
        .alias("unobserved")).collect()
    present = {row["branch"] for row in rows}
    wanted = {b for group in branches.values() for b in group}
    if missing := sorted(wanted - present):
        raise ContractError(f"branches missing from the hierarchy: {missing}")
    in_source = tuple(sorted(row["class_id"] for row in rows))
    unobserved = tuple(sorted(row["class_id"] for row in rows if row["unobserved"]))
    if absent := sorted(set(named.values()) - set(in_source)):
        raise ContractError(f"indicator classes missing from the statistics: {absent}")
    return ClassSemantics(
        named,
        {key: tuple(sorted(r["class_id"] for r in rows if r["branch"] in group))
         for key, group in branches.items()},
        unobserved, tuple(c for c in in_source if c not in unobserved), in_source)


def deepest_level(levels: Sequence[Column]) -> Column:
    """Index of the deepest level that differs from the one above it."""
    deepest = None
    for index in range(len(levels) - 1, 1, -1):
        differs = ~levels[index].eqNullSafe(levels[index - 1])
        deepest = F.when(differs, index) if deepest is None else deepest.when(differs, index)
    return deepest.when(levels[1].isNotNull(), 1).cast("int")


def name_or_level(name: Column, level_name: Column) -> Column:
    """The legend's name, else the hierarchy label without its numbering."""
    return F.coalesce(name, F.regexp_replace(level_name, r"^[0-9.]+\s*", ""))


def class_legend(hierarchy: DataFrame, legend: DataFrame, semantics: ClassSemantics,
                 **lineage) -> DataFrame:
    """All classes of either side with name, level, membership flags and provenance."""
    joined = full_outer_with_flags(hierarchy, legend, "class_id", "is_in_statistics",
                                   "is_in_legend_csv")
    levels = [F.col(f"class_level_{i}_name") for i in range(5)]
    member = lambda ids: F.col("class_id").isin(*ids) if ids else F.lit(None).cast("boolean")
    return with_lineage(joined.select(
        "class_id",
        name_or_level(F.col("class_name_pt_br"), levels[4]).alias("class_name"),
        "class_name_pt_br", "class_name_en", "hex_code",
        deepest_level(levels).alias("class_level"), *levels,
        "is_in_statistics", "is_in_legend_csv",
        member(semantics.mapped).alias("is_mapped_class"),
        *[member(ids).alias(f"is_{name}") for name, ids in semantics.branches.items()],
        F.when(F.col("is_in_legend_csv"), "official_legend_csv")
        .otherwise("statistics_workbook_hierarchy").alias("class_name_source")), **lineage)


def panel_silver(wide: DataFrame, legend: DataFrame, dim: DataFrame,
                 year_columns: Sequence[str], unit: str = "geocode", dim_key: str = "codigo_ibge",
                 biome: str = "biome", class_column: str = "class", region: str = "region",
                 state: str = "state", unit_name: str = "municipality", **lineage) -> DataFrame:
    """Unit x biome x year x class areas with source row count, source lists and match flag.

    The wide rows are added up before they are melted: the shuffle carries one row per unit,
    biome and class instead of one per year as well.  A year cell without any value gives no row.
    """
    value = lambda c: F.col(f"`{c}`").cast("double")
    grain = [F.col(unit).cast("string").alias("codigo_ibge"), F.col(biome).alias("biome_name"),
             F.col(class_column).cast("int").alias("class_id")]
    keys = ["codigo_ibge", "biome_name", "class_id"]
    by_source = wide.groupBy(*grain, F.col(region).alias("region"), F.col(state).alias("state")).agg(
        F.min(unit_name).alias("name"),
        *[F.sum(value(c)).alias(c) for c in year_columns],
        *[F.count(value(c)).alias(f"n_{c}") for c in year_columns])
    seen = F.array(*[F.col(f"n_{c}") > 0 for c in year_columns])
    merged = by_source.groupBy(*keys).agg(
        F.min("name").alias("municipality_name_source"),
        F.collect_list(F.struct("region", "state", seen.alias("seen"))).alias("sources"),
        *[F.sum(c).alias(c) for c in year_columns],
        *[F.sum(f"n_{c}").alias(f"n_{c}") for c in year_columns])
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(int(c[1:])).alias("year"),
                 F.col(c).alias("area_ha"), F.col(f"n_{c}").cast("int").alias("n"))
        for i, c in enumerate(year_columns)]))
    long = merged.select(*keys, "municipality_name_source", "sources", cells.alias("cell")).filter(
        F.col("cell.n") > 0)

    def names(field: str) -> Column:
        here = F.filter("sources", lambda s: F.element_at(s["seen"], F.col("cell.i") + 1)
                        & s[field].isNotNull())
        return F.array_sort(F.array_distinct(F.transform(here, lambda s: s[field])))

    long = long.select(*keys, F.col("cell.year").alias("year"), F.col("cell.area_ha").alias("area_ha"),
                       "municipality_name_source", names("region").alias("source_region_names"),
                       names("state").alias("source_state_names"),
                       F.col("cell.n").alias("source_row_count"))
    described = legend.select(
        "class_id", "class_name", "class_level", *[f"class_level_{i}_name" for i in range(5)],
        *[c for c in legend.columns if c in ("is_mapped_class", "is_native_vegetation",
                                             "is_agriculture_livestock")])
    known = dim.select(F.col(dim_key).alias("codigo_ibge"), F.lit(True).alias("__hit"))
    joined = (long.join(described, "class_id").join(known, "codigo_ibge", "left")
              .withColumn("is_dim_municipality_match", F.coalesce("__hit", F.lit(False)))
              .drop("__hit").withColumn("biome_code", F.lit(None).cast("string")))
    return with_lineage(joined, **lineage)


def panel_fact(silver: DataFrame, unit: str = "codigo_ibge", match: str | None = "is_dim_municipality_match",
               carry: Sequence[str] = ("class_name", "class_level"), area: str = "area_ha",
               class_column: str = "class_id") -> DataFrame:
    """Matched units, biomes merged, hectares and square kilometres."""
    rows = silver.filter(F.col(match)) if match else silver
    summed = rows.groupBy(unit, "year", class_column).agg(
        *[F.min(c).alias(c) for c in carry], F.sum(area).alias("area_ha"))
    return summed.withColumn("area_km2", area_km2(F.col("area_ha")))


def panel_snapshot(silver: DataFrame, mapped: Column, groups: dict[str, Column],
                   unit: str = "codigo_ibge", match: str | None = "is_dim_municipality_match",
                   area: str = "area_ha", carry: Sequence[str] = ()) -> DataFrame:
    """Per unit and year: mapped area, area of each group, square kilometres and share.

    The mapped area stays null when nothing is mapped; group areas are zero.  Groups may overlap.
    """
    rows = silver.filter(F.col(match)) if match else silver
    areas = rows.groupBy(unit, "year").agg(
        F.sum(F.when(mapped, F.col(area))).alias("mapped_area_ha"),
        *[F.coalesce(F.sum(F.when(c, F.col(area))), F.lit(0.0)).alias(f"{g}_area_ha")
          for g, c in groups.items()],
        *[F.min(c).alias(c) for c in carry])
    out = [unit, "year", "mapped_area_ha"]
    for g in groups:
        here = F.col(f"{g}_area_ha")
        out += [f"{g}_area_ha", area_km2(here).alias(f"{g}_area_km2"),
                percentage(here, F.col("mapped_area_ha")).alias(f"{g}_area_pct")]
    return areas.select(*out, *carry)


def panel_groups(semantics: ClassSemantics) -> tuple[Column, dict[str, Column]]:
    """The mapped condition and the five group conditions over SILVER columns."""
    named = {k: F.col("class_id") == v for k, v in semantics.named.items()}
    return F.col("is_mapped_class"), {
        "urban": named["urban"], "native_vegetation": F.col("is_native_vegetation"),
        "agriculture_livestock": F.col("is_agriculture_livestock"),
        "water": named["water"], "wetland": named["wetland"]}


@dataclass(frozen=True)
class ChangeMetric:
    """A value column compared with its own past; ``horizons`` empty means all of them.

    ``absolute`` and ``pct`` are output name patterns taking ``{h}``; ``full`` names the
    comparison with the first year.
    """

    column: str
    prefix: str
    horizons: tuple[int, ...] = ()
    full: bool = True
    pct: bool = True
    change_prefix: str | None = None
    first_name: str | None = None
    latest_name: str | None = None


LAND_COVER_METRICS = (
    ChangeMetric("urban_area_ha", "urban_area", change_prefix="urban_change"),
    ChangeMetric("native_vegetation_area_ha", "native_vegetation",
                 change_prefix="native_vegetation_change"),
    ChangeMetric("water_area_ha", "water_area", (10,), full=False, pct=False,
                 change_prefix="water_area_change"),
    ChangeMetric("wetland_area_ha", "wetland_area", (10,), full=False, pct=False,
                 change_prefix="wetland_area_change"),
)


def panel_change(snapshot: DataFrame, metrics: Sequence[ChangeMetric] = LAND_COVER_METRICS,
                 horizons: Sequence[int] = pn.HORIZONS, unit: str = "codigo_ibge",
                 year: str = "year", carry: Sequence[str] = (),
                 years_from: DataFrame | None = None) -> DataFrame:
    """Change of each metric against the first year and each horizon, in one aggregation.

    First and latest year are global.  A unit missing any reference year has no row.  A
    percentage is null where the base is zero.  ``years_from`` is a cheaper table with the same
    years, for a snapshot that is not stored.
    """
    bounds = (snapshot if years_from is None else years_from).agg(F.min(year).cast("int").alias("first"), F.max(year).cast("int").alias("latest"))
    first, latest = bounds.select("first").scalar(), bounds.select("latest").scalar()
    at = {"first": F.col("__first"), "latest": F.col("__latest"),
          **{h: F.col("__latest") - h for h in horizons}}
    rows = snapshot.withColumns({"__first": first, "__latest": latest})
    wanted = F.lit(False)
    for ref in at.values():
        wanted = wanted | (F.col(year) == ref)
    pick = lambda column, ref: F.max(F.when(F.col(year) == at[ref], F.col(column)))
    aggregates = [F.count_if(F.col(year) == ref).alias(f"has_{key}") for key, ref in at.items()]
    for m in metrics:
        for key in at:
            aggregates.append(pick(m.column, key).alias(f"{m.prefix}@{key}"))
    aggregates += [pick(c, "latest").alias(c) for c in carry]
    rolled = rows.filter(wanted).groupBy(unit, "__first", "__latest").agg(*aggregates)
    for key in at:
        rolled = rolled.filter(F.col(f"has_{key}") > 0)
    out = [F.col(unit), F.col("__first").alias("first_year"), F.col("__latest").alias("latest_year"),
           *[(F.col("__latest") - h).alias(f"reference_year_{h}y") for h in horizons]]
    for m in metrics:
        now = F.col(f"`{m.prefix}@latest`")
        change = m.change_prefix or f"{m.prefix}_change"
        if m.full:
            base = F.col(f"`{m.prefix}@first`")
            out += [base.alias(m.first_name or f"{m.prefix}_first_year_ha"),
                    now.alias(m.latest_name or f"{m.prefix}_latest_year_ha"),
                    (now - base).alias(f"{m.prefix}_change_ha")]
            if m.pct:
                out.append(pct_change(now, base).alias(f"{m.prefix}_change_pct"))
        for h in m.horizons or horizons:
            base = F.col(f"`{m.prefix}@{h}`")
            out.append((now - base).alias(f"{change}_{h}y_ha"))
            if m.pct:
                out.append(pct_change(now, base).alias(f"{change}_{h}y_pct"))
    return rolled.select(*out, *carry)


def hide_missing_references(change: DataFrame, history_years: Column,
                            horizons: Sequence[int] = pn.HORIZONS,
                            prefixes: Sequence[str] = ("urban", "native_vegetation")) -> DataFrame:
    """Null out a horizon's year and changes when the unit's history lacks that year."""
    updates = {}
    for h in horizons:
        here = F.array_contains(history_years, F.col(f"reference_year_{h}y"))
        for column in [f"reference_year_{h}y"] + [f"{p}_change_{h}y_{u}" for p in prefixes
                                                  for u in ("ha", "pct")]:
            updates[column] = F.when(here, F.col(column))
    return change.withColumns(updates)


def change_for_period(change: DataFrame, period: str | int, prefix: str,
                      unit: str = "codigo_ibge") -> DataFrame:
    """Absolute and percentage change of one metric over ``full`` or a number of years."""
    if period == "full":
        stem = "urban_area_change" if prefix == "urban" else f"{prefix}_change"
        start = "first_year"
    else:
        stem, start = f"{prefix}_change_{period}y", f"reference_year_{period}y"
    return change.select(unit, F.col(start).alias("start_year"),
                         F.col(f"{stem}_ha").alias("change_ha"),
                         F.col(f"{stem}_pct").alias("change_pct"))


def history_since(history: DataFrame, start_year: int | Column, share: bool, group: str,
                  unit: str = "codigo_ibge") -> DataFrame:
    """A group's series from a start year, as share of the mapped area or in square kilometres."""
    value = F.col(f"{group}_area_pct") if share else area_km2(F.col(f"{group}_area_ha"))
    return history.filter(F.col("year") >= start_year).select(unit, "year", value.alias("value"))


def multi_group_units(rows: DataFrame, unit: str, group: str) -> DataFrame:
    """Units that lie in more than one group, with the sorted list of them."""
    members = rows.select(unit, group).distinct()
    return (members.groupBy(unit).agg(F.sort_array(F.collect_list(group)).alias("groups"))
            .filter(F.size("groups") > 1))
