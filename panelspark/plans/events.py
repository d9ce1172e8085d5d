"""Event run: contract CSV and landed sheets to event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.operators import conform, events as op, keys
from panelspark.operators.release import input_signature, output_fingerprints, release_impact
from panelspark.plans.runner import Layout, Stage, run_source
from panelspark.presets import events as ev
from panelspark.quality import checks as q
from panelspark.sources.readers import file_inventory, read_contract_csv, read_landed_sheet, with_source_row_number

VERSION = "events-1"
TABLES = ("dim_disaster_type", "monetary_correction_factor", "silver_disaster_event",
          "fact_disaster_event", "snapshot_municipality_disaster_history",
          "municipality_disaster_type_summary", "municipality_disaster_month_profile")
FACTOR_COLUMN = "fator para conversão - valores de dezembro de 2024"


def event_tables(stage: Stage, raw: DataFrame, dim: DataFrame, type_sheet: DataFrame,
                 factor_sheet: DataFrame, factor_column: str = FACTOR_COLUMN, **lineage) -> dict[str, DataFrame]:
    """SILVER once, then FACT and the three GOLD aggregates from it."""
    types = stage.save("dim_disaster_type", conform.event_types(type_sheet, **lineage), ["cobrade_code"])
    factors = stage.save("monetary_correction_factor",
                         conform.correction_factors(factor_sheet, factor_column, **lineage))
    reference = op.monetary_reference(factors).first()
    silver = stage.save("silver_disaster_event", conform.ingest_events(
        raw, dim, reference.reference_year, **lineage))
    fact = stage.save("fact_disaster_event", conform.event_fact(silver),
                      ["codigo_ibge", "event_date", "disaster_event_id"])
    unit, rain = "codigo_ibge", "is_rain_related"
    stamp = {k: F.lit(v) for k, v in lineage.items()}
    snapshot = op.history_snapshot(dim, fact, unit, "event_date", rain, "rain_related",
                                   ev.IMPACT_COLUMNS).withColumns(stamp)
    summary = op.type_summary(fact, [unit, "cobrade_code"], "event_date", ev.IMPACT_COLUMNS,
                              carry=list(lineage))
    months = op.month_profile(dim, fact, unit, "event_month", rain, "rain_related").withColumns(stamp)
    return {
        "dim_disaster_type": types, "monetary_correction_factor": factors,
        "silver_disaster_event": silver, "fact_disaster_event": fact,
        "snapshot_municipality_disaster_history": stage.save(
            "snapshot_municipality_disaster_history", snapshot, [unit]),
        "municipality_disaster_type_summary": stage.save(
            "municipality_disaster_type_summary", summary, [unit, "cobrade_code"]),
        "municipality_disaster_month_profile": stage.save(
            "municipality_disaster_month_profile", months, [unit, "month"])}


def event_checks(tables: dict[str, DataFrame], raw: DataFrame, dim: DataFrame, first_year: int,
                 latest_year: int, inventory: DataFrame | None = None,
                 original_ids: DataFrame | None = None, corrected: DataFrame | None = None) -> DataFrame:
    """The checks of the event source; the workbook ones run when the copies are given."""
    silver, fact = tables["silver_disaster_event"], tables["fact_disaster_event"]
    snapshot = tables["snapshot_municipality_disaster_history"]
    summary = tables["municipality_disaster_type_summary"]
    months = tables["municipality_disaster_month_profile"]
    name = "silver_disaster_event"
    year, factor = F.col("reference_year"), F.col("correction_factor")
    reference = ev.CORRECTION_REFERENCE
    sum_of = F.sum("event_count")
    spark = silver.sparkSession
    known = F.count_if("is_dim_municipality_match")
    parts = [
        q.aggregate_checks(silver, name, [
            q.derived_dates("event_date", "event_year", "event_month", first_year, latest_year,
                            "event_dates_match_declared_release_and_derived_fields"),
            q.not_null(("source_event_id", "codigo_ibge", "event_date", "registration_date",
                        "cobrade_code", "status_source"),
                       ("source_event_id", "codigo_ibge", "cobrade_code", "status_source"),
                       "silver_required_fields_are_present"),
            q.matches({"codigo_ibge": "[0-9]{7}", "cobrade_code": "[0-9]{5}"},
                      "territorial_and_cobrade_codes_have_valid_shapes"),
            q.non_negative(ev.NON_NEGATIVE, "counts_and_monetary_values_are_nonnegative"),
            q.row_identity(ev.HUMAN_TOTALS, name="human_impact_totals_reconcile"),
            q.row_identity(ev.MONEY_TOTALS, ev.MONEY_TOLERANCE,
                           "monetary_component_totals_reconcile_with_rounding_tolerance"),
            q.Check("recognition_status_values_are_known",
                    {"values": F.sort_array(F.collect_set("status_source"))},
                    f"only {' and '.join(ev.STATUSES)}",
                    lambda c: c["values"] == F.array(*[F.lit(s) for s in sorted(ev.STATUSES)]))]),
        q.unique(silver, name, ["source_event_id"], "source_event_id_is_unique"),
        q.dimension_agrees(silver, tables["dim_disaster_type"], "cobrade_code", {
            "atlas_type_id": "atlas_type_id", "atlas_type_name_source": "atlas_type_name",
            "atlas_group_name_source": "atlas_group_name", "is_rain_related": "is_rain_related"},
            name, "cobrade_codes_and_classification_match_official_dimension"),
        q.aggregate_checks(tables["monetary_correction_factor"], "monetary_correction_factor", [
            q.rules("igp_di_correction_reference_is_consistent", {
                "nonzero_pre_real_factors": year.between(*reference["zero_years"]) & (factor != 0),
                "invalid_reference_rows": (year == reference["year"]) & (
                    (factor != 1) | (F.abs(F.col("igp_di_december_index") - reference["index"]) > 1e-9))})]),
        q.subset(silver, dim, ["codigo_ibge"], name, "source_municipalities_match_dim_municipality_by_code"),
        q.judge(q.side_by_side(spark, {
            "raw": (raw, F.count("*")), "silver": (silver, F.count("*")), "fact": (fact, F.count("*")),
            "fact_duplicate_keys": (keys.duplicate_keys(fact, ["codigo_ibge", "disaster_event_id"]), F.count("*")),
        }), "fact_disaster_event", "raw_silver_fact_rows_and_fact_grain_reconcile",
            "raw = silver = fact, no duplicate key",
            lambda c: (c["raw"] == c["silver"]) & (c["silver"] == c["fact"]) & (c["fact_duplicate_keys"] == 0)),
        q.judge(q.side_by_side(spark, {
            "units": (dim, F.count("*")), "snapshot_rows": (snapshot, F.count("*")),
            "month_rows": (months, F.count("*")), "fact_rows": (fact, F.count("*")),
            "matched_rows": (silver, known), "snapshot_sum": (snapshot, sum_of),
            "type_sum": (summary, sum_of), "month_sum": (months, sum_of),
            "snapshot_duplicates": (keys.duplicate_keys(snapshot, ["codigo_ibge", "reference_date"]), F.count("*")),
            "type_duplicates": (keys.duplicate_keys(summary, ["codigo_ibge", "cobrade_code"]), F.count("*")),
            "month_duplicates": (keys.duplicate_keys(months, ["codigo_ibge", "month"]), F.count("*")),
        }), "gold", "gold_grains_and_event_counts_reconcile",
            "snapshot = units, months = 12 x units, no duplicate key, sums equal the matched events",
            lambda c: (c["snapshot_rows"] == c["units"]) & (c["month_rows"] == 12 * c["units"])
            & (c["snapshot_duplicates"] + c["type_duplicates"] + c["month_duplicates"] == 0)
            & (c["snapshot_sum"] == c["matched_rows"]) & (c["month_sum"] == c["matched_rows"])
            & (c["type_sum"] == c["fact_rows"])),
    ]
    if inventory is not None:
        parts.append(q.non_empty(inventory, "raw", "raw_resources_are_nonempty_and_readable"))
    if original_ids is None or corrected is None:
        parts.append(q.not_run(spark, "raw", "csv_and_workbook_event_sets_reconcile", "no workbook copies were given"))
    else:
        key = "Protocolo_S2iD"
        compared = keys.compare_copies(raw, corrected, key, conform.workbook_comparators())
        to_original = keys.key_comparison_counts(raw, original_ids, [key])
        to_corrected = keys.key_comparison_counts(raw, corrected, [key])
        only = lambda side: F.max(side)
        parts.append(q.judge(q.side_by_side(spark, {
            "csv_rows": (raw, F.count("*")), "original_rows": (original_ids, F.count("*")),
            "corrected_rows": (corrected, F.count("*")),
            "csv_ids_missing_from_original": (to_original, only("left_only")),
            "original_ids_missing_from_csv": (to_original, only("right_only")),
            "csv_ids_missing_from_corrected": (to_corrected, only("left_only")),
            "corrected_ids_missing_from_csv": (to_corrected, only("right_only")),
            "corrected_rows_with_value_differences": (
                compared, F.coalesce(F.sum(F.when(~F.col("all_fields_match"), F.col("pairs"))), F.lit(0))),
        }), "raw", "csv_and_workbook_event_sets_reconcile", "equal rows and ids, no value difference",
            lambda c: (c["original_rows"] == c["csv_rows"]) & (c["corrected_rows"] == c["csv_rows"])
            & (c["csv_ids_missing_from_original"] + c["original_ids_missing_from_csv"]
               + c["csv_ids_missing_from_corrected"] + c["corrected_ids_missing_from_csv"]
               + c["corrected_rows_with_value_differences"] == 0)))
    return q.union_checks(parts)


def event_anomalies(silver: DataFrame) -> DataFrame:
    """Anomalies that are kept and counted, never failed."""
    return q.anomaly_report(silver, {
        "invalid_protocol_format": ~F.col("is_protocol_format_valid"),
        "protocol_ibge_conflicts": ~F.col("is_protocol_ibge_consistent"),
        "protocol_cobrade_conflicts": ~F.col("is_protocol_cobrade_consistent"),
        "event_after_registration": F.col("is_event_after_registration"),
    }, ["codigo_ibge", "event_date", "cobrade_code"], "codigo_ibge", "municipality_name_source")


def event_impact(previous: dict[str, DataFrame], current: dict[str, DataFrame]) -> DataFrame:
    """Ids, units and codes a new release adds and removes."""
    labels = {"event_ids": ("fact_disaster_event", "disaster_event_id"),
              "municipality_codes": ("fact_disaster_event", "codigo_ibge"),
              "cobrade_codes": ("dim_disaster_type", "cobrade_code")}
    pick = lambda tables: {k: (tables[t], c) for k, (t, c) in labels.items()}
    return release_impact(pick(previous), pick(current))


def run_events(spark: SparkSession, layout: Layout, csv_path: str, types_path: str, factors_path: str,
               release: str, first_year: int, latest_year: int, source_hashes: dict[str, str],
               original_path: str | None = None, corrected_path: str | None = None, **lineage) -> dict:
    raw = with_source_row_number(read_contract_csv(spark, csv_path, ev.EVENT_CONTRACT, cp1252=True))
    dim = spark.read.parquet(layout.table("dim_municipality"))
    # Content is not read: sizes alone tell an empty file.
    copies = {"inventory": file_inventory(spark, csv_path, digests=False).select("path", "content_length")}
    if original_path and corrected_path:
        copies |= {"original_ids": read_landed_sheet(spark, original_path).select("Protocolo_S2iD"),
                  "corrected": read_landed_sheet(spark, corrected_path)}

    def build(stage: Stage) -> dict[str, DataFrame]:
        return event_tables(stage, raw, dim, read_landed_sheet(spark, types_path),
                            read_landed_sheet(spark, factors_path), source_release=release, **lineage)

    return run_source(
        spark, layout, "events", release,
        input_signature(release, source_hashes, **output_fingerprints({"dimension": dim})), VERSION, build,
        lambda tables: event_checks(tables, raw, dim, first_year, latest_year, **copies),
        event_impact, TABLES,
        archive=tuple(t for t in TABLES if t not in ("silver_disaster_event", "monetary_correction_factor")))
