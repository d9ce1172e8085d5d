"""Territory run: nested listing to unit dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.operators import conform
from panelspark.operators.release import input_signature
from panelspark.plans.runner import Layout, Stage, run_source
from panelspark.presets import units as un
from panelspark.quality import checks as q
from panelspark.sinks.writers import write_csv
from panelspark.sources.readers import read_nested_json

VERSION = "units-1"
TABLES = ("silver_units", "dim_municipality")


def unit_checks(dim: DataFrame, official_codes: DataFrame, expected_rows: int,
                examples=un.EXAMPLES) -> DataFrame:
    """The ten checks of the unit dimension."""
    special = F.lit(False)
    for code, kind in un.SPECIAL_TYPES.items():
        special = special | ((F.col("codigo_ibge") == code) & (F.col("tipo_unidade_territorial") != kind))
    levels = ("regiao_imediata", "codigo_regiao_imediata", "regiao_intermediaria",
              "codigo_regiao_intermediaria")
    name = "dim_municipality"
    return q.union_checks([
        q.aggregate_checks(dim, name, [
            q.row_count(expected_rows, "record_count_matches_official_api_response"),
            q.not_null(un.REQUIRED, name="required_fields_are_not_null"),
            q.matches(un.CODE_PATTERNS, "administrative_code_formats_are_valid", {
                "municipality_uf_prefix_conflicts":
                    F.substring("codigo_ibge", 1, 2) != F.col("codigo_uf_ibge")}),
            q.not_null(levels, name="current_geographic_regions_are_complete"),
            q.rule("special_territorial_units_are_classified", special)]),
        q.unique(dim, name, ["codigo_ibge"], "codigo_ibge_is_unique"),
        q.same_keys(official_codes, dim, ["codigo_ibge"], name,
                    "codigo_ibge_set_matches_official_api_response"),
        q.functional_dependency(dim, name, ["codigo_ibge"], ["codigo_uf_ibge"],
                                "each_municipality_belongs_to_exactly_one_uf"),
        q.functional_dependency(dim, name, ["codigo_uf_ibge"], ["codigo_regiao"],
                                "each_uf_belongs_to_exactly_one_region"),
        q.contains_keys(dim, name, "codigo_ibge", examples,
                        "required_documentation_examples_are_present")])


def run_units(spark: SparkSession, layout: Layout, raw_path: str, release: str,
              source_hashes: dict[str, str], examples=un.EXAMPLES, **lineage) -> dict:
    raw = read_nested_json(spark, raw_path, un.UNIT_SCHEMA)

    def build(stage: Stage) -> dict[str, DataFrame]:
        silver = stage.save("silver_units", conform.conform_units(raw, **lineage), ["sigla_uf", "municipio"])
        dim = stage.save("dim_municipality", conform.unit_dimension(silver), ["sigla_uf", "municipio"])
        return {"silver_units": silver, "dim_municipality": dim}

    def checks(tables):
        codes = raw.select(F.col("id").cast("string").alias("codigo_ibge"))
        return unit_checks(tables["dim_municipality"], codes, raw.count(), examples)

    record = run_source(spark, layout, "units", release, input_signature(release, source_hashes),
                        VERSION, build, checks, tables=TABLES)
    if record["status"] == "SUCCESS":
        write_csv(spark.read.parquet(layout.table("dim_municipality")),
                  f"{layout.root.rstrip('/')}/export/dim_municipality_csv")
    return record
