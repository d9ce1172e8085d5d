"""The documented consumer queries over the published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelspark.operators.keys import latest_per_key


def units_of_state(dim: DataFrame, state: str, limit: int = 10) -> DataFrame:
    return (dim.filter(F.col("sigla_uf") == state).select("codigo_ibge", "municipio", "sigla_uf")
            .orderBy("municipio").limit(limit))


def integrated_profile(dim: DataFrame, land_cover: DataFrame, history: DataFrame,
                       code: str | None = None) -> DataFrame:
    """Latest panel year (global) and event history beside every unit, or one unit."""
    latest = land_cover.filter(F.col("year") == land_cover.agg(F.max("year")).scalar()).select(
        "codigo_ibge", F.col("year").alias("land_cover_year"), "urban_area_pct",
        "native_vegetation_area_pct", "water_area_pct")
    events = history.select(
        "codigo_ibge", F.col("reference_date").alias("disaster_reference_date"), "event_count",
        "rain_related_event_count", "event_count_10y", "reported_affected_total")
    wanted = dim if code is None else dim.filter(F.col("codigo_ibge") == code)
    return (wanted.select("codigo_ibge", "municipio", "sigla_uf")
            .join(latest, "codigo_ibge", "left").join(events, "codigo_ibge", "left"))


def indicator_series(land_cover: DataFrame, code: str) -> DataFrame:
    return (land_cover.filter(F.col("codigo_ibge") == code)
            .select("year", "urban_area_ha", "urban_area_pct", "native_vegetation_area_ha", "water_area_ha")
            .orderBy("year"))


def class_series(fact: DataFrame, code: str, class_id: int) -> DataFrame:
    return (fact.filter((F.col("codigo_ibge") == code) & (F.col("class_id") == class_id))
            .select("year", "class_id", "class_name", "area_ha", "area_km2").orderBy("year"))


def events_by_type(summary: DataFrame, dim: DataFrame, types: DataFrame, code: str) -> DataFrame:
    rows = summary.filter(F.col("codigo_ibge") == code)
    return (rows.join(dim.select("codigo_ibge", "municipio", "sigla_uf"), "codigo_ibge")
            .join(types.select("cobrade_code", "disaster_name", "is_rain_related"), "cobrade_code", "left")
            .select("municipio", "sigla_uf", "cobrade_code", "disaster_name", "is_rain_related", "event_count",
                    "first_event_date", "latest_event_date", "reported_affected_total")
            .orderBy(F.desc("event_count"), "cobrade_code"))


def yearly_impact(fact: DataFrame, code: str) -> DataFrame:
    return (fact.filter(F.col("codigo_ibge") == code).groupBy("event_year").agg(
        F.count("*").alias("event_count"), F.sum("deaths").alias("deaths"),
        F.sum("reported_affected_total").alias("reported_affected_total")).orderBy("event_year"))


def month_profile(months: DataFrame, code: str) -> DataFrame:
    return (months.filter(F.col("codigo_ibge") == code)
            .select("month", "event_count", "rain_related_event_count").orderBy("month"))


def latest_snapshot(land_cover: DataFrame) -> DataFrame:
    """Own latest year of every unit."""
    return latest_per_key(land_cover, ["codigo_ibge"], ["year"])


def change_ranking(change: DataFrame, dim: DataFrame, column: str = "urban_area_change_ha") -> DataFrame:
    return (change.select("codigo_ibge", "first_year", "latest_year", column)
            .join(dim.select("codigo_ibge", "municipio", "sigla_uf"), "codigo_ibge")
            .orderBy(F.desc_nulls_last(column), "codigo_ibge"))


def units_in_several_biomes(silver: DataFrame) -> DataFrame:
    members = silver.select("codigo_ibge", "biome_name").distinct()
    return (members.groupBy("codigo_ibge").agg(F.sort_array(F.collect_list("biome_name")).alias("biomes"))
            .filter(F.size("biomes") > 1).orderBy("codigo_ibge"))


def unmatched_units(silver: DataFrame) -> DataFrame:
    return (silver.filter(~F.col("is_dim_municipality_match"))
            .select("codigo_ibge", "municipality_name_source").distinct())
