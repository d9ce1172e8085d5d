"""Survey run: landed answer sheet to states for every current unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.functions.states import GOLD_STATES
from panelspark.operators import conform
from panelspark.operators.release import input_signature, output_fingerprints
from panelspark.plans.runner import Layout, Stage, run_source
from panelspark.presets import survey as sv
from panelspark.quality import checks as q
from panelspark.sources.readers import read_landed_sheet

VERSION = "survey-1"
TABLES = ("silver_survey", "municipality_munic_capacity_2020")


def survey_tables(stage: Stage, sheet: DataFrame, dim: DataFrame, **lineage) -> dict[str, DataFrame]:
    silver = stage.save("silver_survey", conform.survey_silver(sheet, **lineage), ["codigo_ibge"])
    gold = conform.survey_gold(dim, silver, "codigo_ibge", sv.STATUS_COLUMNS, ("municipio", "sigla_uf"),
                               ("municipio_fonte", "source_year", *lineage), sv.REFERENCE_YEAR)
    return {"silver_survey": silver,
            "municipality_munic_capacity_2020": stage.save(
                "municipality_munic_capacity_2020", gold, ["codigo_ibge"])}


def survey_checks(tables: dict[str, DataFrame], dim: DataFrame, expected_rows: int, expected_units: int,
                  outside: list[str], expected_yes: dict[str, int] = sv.EXPECTED_YES) -> DataFrame:
    """The nine checks of the survey; golden counts are those of the published release."""
    silver, gold = tables["silver_survey"], tables["municipality_munic_capacity_2020"]
    conflict = ((F.col("municipal_civil_defense_body_status") == "declared_yes")
                & (F.col("civil_defense_budget_provision_status") == "not_applicable"))
    absent = gold.filter(~F.col("in_source"))
    return q.union_checks([
        q.aggregate_checks(silver, "silver_survey", [
            q.row_count(expected_rows, "source_has_expected_municipalities"),
            q.matches({"codigo_ibge": "[0-9]{7}"}, "source_codigo_ibge_format_is_valid"),
            q.rule("budget_not_applicable_is_not_used_for_declared_body", conflict),
            q.expected_counts({c: (F.col(c) == "declared_yes", n) for c, n in expected_yes.items()},
                              "selected_indicator_counts_match_release")]),
        q.aggregate_checks(gold, "gold_survey", [
            q.row_count(expected_units, "gold_matches_current_dimension"),
            q.allowed_values(sv.STATUS_COLUMNS, GOLD_STATES, "status_values_follow_contract")]),
        q.unique(silver, "silver_survey", ["codigo_ibge"], "source_codigo_ibge_is_unique"),
        q.subset(silver, dim, ["codigo_ibge"], "silver_survey", "all_source_codes_match_current_dimension"),
        q.judge(_outside_counts(absent, outside), "gold_survey",
                "new_municipalities_are_explicitly_outside_the_source",
                {"outside_but_not_expected": 0, "expected_but_not_outside": 0})])


def _outside_counts(absent: DataFrame, outside: list[str]) -> DataFrame:
    """Units outside the source that are not on the expected list, and the other way round."""
    named = absent.select("codigo_ibge").distinct()
    extra = named.filter(~F.col("codigo_ibge").isin(*outside)) if outside else named
    found = named.filter(F.col("codigo_ibge").isin(*outside)) if outside else named.filter("false")
    return extra.agg(F.count("*").alias("outside_but_not_expected")).withColumn(
        "expected_but_not_outside", F.lit(len(set(outside))) - found.agg(F.count("*")).scalar()).select(
        F.col("outside_but_not_expected"), F.col("expected_but_not_outside"))


def outside_rows(gold: DataFrame, outside: list[str]) -> DataFrame:
    """Every unit outside the source, with whether it was expected there: the check's full list."""
    return gold.filter(~F.col("in_source")).select(
        "codigo_ibge", F.col("codigo_ibge").isin(*outside).alias("expected") if outside else F.lit(False).alias("expected"))


def run_survey(spark: SparkSession, layout: Layout, sheet_path: str, release: str,
               source_hashes: dict[str, str], expected_rows: int, expected_units: int, outside: list[str],
               expected_yes: dict[str, int] = sv.EXPECTED_YES, **lineage) -> dict:
    sheet = read_landed_sheet(spark, sheet_path)
    dim = spark.read.parquet(layout.table("dim_municipality"))
    return run_source(
        spark, layout, "survey", release,
        input_signature(release, source_hashes, **output_fingerprints({"dimension": dim})), VERSION,
        lambda stage: survey_tables(stage, sheet, dim, source_release=release, **lineage),
        lambda tables: survey_checks(tables, dim, expected_rows, expected_units, outside, expected_yes),
        tables=TABLES)
