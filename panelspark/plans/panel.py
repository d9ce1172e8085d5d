"""Panel run: wide yearly sheet and class legend to panel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.operators import keys, panel as op
from panelspark.operators.release import common_period_diff, input_signature, output_fingerprints, release_impact
from panelspark.plans.runner import Layout, Stage, run_source
from panelspark.presets import panel as pn
from panelspark.quality import checks as q
from panelspark.sources.readers import read_typed_csv, read_wide_panel

VERSION = "panel-1"
TABLES = ("class_legend", "silver_land_cover", "fact_municipality_land_cover",
          "snapshot_municipality_land_cover", "municipality_land_cover_change")


def panel_tables(stage: Stage, wide: DataFrame, legend: DataFrame, dim: DataFrame,
                 year_columns: list[str], documented: dict[str, int] | None = None,
                 **lineage) -> tuple[dict[str, DataFrame], op.ClassSemantics]:
    hierarchy = op.class_hierarchy(wide)
    semantics = op.class_semantics(hierarchy, legend, documented=documented)
    carry = list(lineage)
    legend_table = stage.save("class_legend", op.class_legend(hierarchy, legend, semantics, **lineage), ["class_id"])
    silver = stage.save("silver_land_cover", op.panel_silver(
        wide, legend_table, dim, year_columns, **lineage).repartition("codigo_ibge"),
        ["codigo_ibge", "biome_name", "year", "class_id"])
    fact = stage.save("fact_municipality_land_cover", op.panel_fact(
        silver, carry=("class_name", "class_level", *carry)), ["codigo_ibge", "year", "class_id"])
    mapped, groups = op.panel_groups(semantics)
    snapshot = stage.save("snapshot_municipality_land_cover", op.panel_snapshot(
        silver, mapped, groups, carry=carry), ["codigo_ibge", "year"])
    change = stage.save("municipality_land_cover_change", op.panel_change(snapshot, carry=carry), ["codigo_ibge"])
    return {"class_legend": legend_table, "silver_land_cover": silver,
            "fact_municipality_land_cover": fact, "snapshot_municipality_land_cover": snapshot,
            "municipality_land_cover_change": change}, semantics


def panel_checks(tables: dict[str, DataFrame], semantics: op.ClassSemantics, wide: DataFrame,
                 dim: DataFrame, first_year: int, latest_year: int, examples=()) -> DataFrame:
    """The ten checks of the panel source (the file check needs an inventory and is separate)."""
    silver, fact = tables["silver_land_cover"], tables["fact_municipality_land_cover"]
    snapshot = tables["snapshot_municipality_land_cover"]
    spark = silver.sparkSession
    required = ("codigo_ibge", "biome_name", "year", "class_id", "class_name", "class_level", "area_ha")
    grains = wide.select("geocode", "biome", "class").distinct()
    years = latest_year - first_year + 1
    used = {*semantics.named.values(), *(c for ids in semantics.branches.values() for c in ids)}
    shares = [c for c in snapshot.columns if c.endswith("_pct")]
    parts = [
        q.aggregate_checks(silver, "silver_land_cover", [
            q.series_complete("year", first_year, latest_year, "annual_series_is_complete"),
            q.rules("silver_required_fields_and_nonnegative_area", {
                **{c: F.col(c).isNull() for c in required}, "negative_area": F.col("area_ha") < 0})]),
        q.judge(q.side_by_side(spark, {
            "rows": (silver, F.count("*")), "grains": (grains, F.count("*")),
            "duplicate_keys": (keys.duplicate_keys(
                silver, ["codigo_ibge", "biome_name", "year", "class_id"]), F.count("*"))}),
            "silver_land_cover", "silver_grain_is_unique_and_reconciled", "rows = grains x years",
            lambda c: (c["rows"] == c["grains"] * years) & (c["duplicate_keys"] == 0)),
        q.coverage(silver, dim, "codigo_ibge", pn.COVERAGE_THRESHOLD_PCT, "silver_land_cover",
                   "municipality_dimension_coverage"),
        q.judge(q.side_by_side(spark, {
            "duplicate_keys": (keys.duplicate_keys(fact, ["codigo_ibge", "year", "class_id"]), F.count("*")),
            "aggregation_differences": (q.rollup_differences(
                silver.filter("is_dim_municipality_match"), fact, ["codigo_ibge", "year", "class_id"],
                "area_ha", pn.AREA_TOLERANCE), F.count("*"))}),
            "fact_municipality_land_cover", "fact_grain_and_biome_sum_are_correct",
            {"duplicate_keys": 0, "aggregation_differences": 0}),
        q.contains_keys(tables["class_legend"].filter("is_in_statistics"), "class_legend", "class_id",
                        sorted(used), "indicator_classes_come_from_official_hierarchy"),
        q.stable_over_time(snapshot, "codigo_ibge", "mapped_area_ha", pn.VARIATION_WARNING_PCT,
                           pn.VARIATION_FAILURE_PCT, "snapshot_municipality_land_cover",
                           "mapped_municipality_area_is_positive_and_stable"),
        q.aggregate_checks(snapshot, "snapshot_municipality_land_cover", [
            q.bounded(shares, 0, 100, pn.PERCENTAGE_TOLERANCE, "snapshot_percentages_are_bounded")])]
    if examples:
        parts.append(q.contains_keys(tables["municipality_land_cover_change"],
                                     "municipality_land_cover_change", "codigo_ibge", examples,
                                     "required_municipality_examples_are_present"))
    return q.union_checks(parts)


def panel_impact(previous: dict[str, DataFrame], current: dict[str, DataFrame]) -> DataFrame:
    """Classes and units added and removed, and indicator differences in the last common year."""
    pick = lambda t: {"class_ids": (t["class_legend"].filter("is_in_statistics"), "class_id"),
                      "municipalities": (t["snapshot_municipality_land_cover"], "codigo_ibge")}
    counts = release_impact(pick(previous), pick(current))
    diff = common_period_diff(previous["snapshot_municipality_land_cover"],
                              current["snapshot_municipality_land_cover"], "codigo_ibge", "year",
                              ["urban_area_ha", "native_vegetation_area_ha"])
    return counts.withColumns({c: diff.select(c).scalar() for c in diff.columns})


def run_panel(spark: SparkSession, layout: Layout, wide_path: str, legend_path: str, release: str,
              first_year: int, latest_year: int, source_hashes: dict[str, str],
              documented: dict[str, int] | None = None, examples=(), **lineage) -> dict:
    wide = spark.read.parquet(wide_path)
    year_columns = read_wide_panel(wide, pn.WIDE_PREFIX, first_year, latest_year)
    legend = read_typed_csv(spark, legend_path, pn.LEGEND_CONTRACT)
    dim = spark.read.parquet(layout.table("dim_municipality"))
    resolved = {}

    def build(stage: Stage) -> dict[str, DataFrame]:
        tables, resolved["semantics"] = panel_tables(
            stage, wide, legend, dim, year_columns, documented, collection_version=release, **lineage)
        return tables

    return run_source(
        spark, layout, "panel", release,
        input_signature(release, source_hashes, **output_fingerprints({"dimension": dim})), VERSION, build,
        lambda tables: panel_checks(tables, resolved["semantics"], wide, dim, first_year, latest_year, examples),
        panel_impact, TABLES, archive=[t for t in TABLES if t != "silver_land_cover"])
