"""Publish the unit profiles: gate on run records, assemble, check, pack, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from panelspark.operators import profiles
from panelspark.operators.release import StaleOutput, verify_outputs
from panelspark.plans.runner import Layout, previous_run, published
from panelspark.presets import events as ev, profiles as pf
from panelspark.operators.shards import read_shard_documents, shard_documents
from panelspark.sinks.writers import replace_on_success, write_json_lines, write_named_texts, write_parquet
from panelspark.sources.contracts import ContractError

#: Where shard files lie below the site's root, as the index names them.
SHARD_ROOT = "/data/v1/uf/"

INPUTS = {
    "dim": "dim_municipality", "snapshot": "snapshot_municipality_disaster_history",
    "types": "municipality_disaster_type_summary", "months": "municipality_disaster_month_profile",
    "fact": "fact_disaster_event", "history": "snapshot_municipality_land_cover",
    "change": "municipality_land_cover_change", "survey": "municipality_munic_capacity_2020",
}


def verify_inputs(spark: SparkSession, layout: Layout, sources=("units", "events", "panel", "survey")) -> dict:
    """The last successful run of each source, after checking its tables against it."""
    runs = {}
    for source in sources:
        run = previous_run(spark, layout, source)
        if run is None:
            raise StaleOutput(f"no successful run of {source}")
        recorded = run["output_fingerprints"] or {}
        verify_outputs(recorded, {name: published(spark, layout, name) for name in recorded})
        runs[source] = run
    return runs


def metadata(dim: DataFrame, fact: DataFrame, history: DataFrame, runs: dict[str, dict]) -> DataFrame:
    """One row: universe, sources with release and year range, event type catalogue."""
    spark = dim.sparkSession
    bounds = lambda df, year: (df.agg(F.min(year)).scalar().cast("int"), df.agg(F.max(year)).scalar().cast("int"))
    first_event, last_event = bounds(fact, "event_year")
    first_panel, last_panel = bounds(history, "year")
    text = lambda source, field: F.lit(str(runs[source][field]))
    entry = lambda source: {"release": text(source, "release"), "materialized_at": text(source, "finished_at"),
                            "source_sha256": text(source, "input_signature"), "manifest": text(source, "run_id")}
    catalogue = F.array(*[profiles.record(
        atlas_type_id=F.lit(i), name=F.lit(name), cobrade_codes=F.array(*[F.lit(c) for c in codes]))
        for i, name, codes in ev.RAIN_CATALOGUE])
    return spark.range(1).select(
        F.lit(pf.SCHEMA_VERSION).alias("schema_version"),
        profiles.record(id=F.lit(pf.UNIVERSE), municipality_count=dim.agg(F.count("*")).scalar()).alias("territorial_universe"),
        profiles.record(
            ibge=profiles.record(**entry("units")),
            atlas=profiles.record(**entry("events"), first_year=first_event, latest_year=last_event, catalog=catalogue),
            mapbiomas=profiles.record(**entry("panel"), first_year=first_panel, latest_year=last_panel),
            munic=profiles.record(**entry("survey"), state=F.lit("self_reported")),
            census=profiles.record(state=F.lit(pf.LEGACY_PROVENANCE)),
            transferegov=profiles.record(state=F.lit(pf.LEGACY_PROVENANCE))).alias("sources"))


def metadata_problems(meta: DataFrame, expected_units: int) -> DataFrame:
    """Names of broken metadata rules."""
    atlas, panel = F.col("sources.atlas"), F.col("sources.mapbiomas")
    codes = F.flatten(F.transform(atlas["catalog"], lambda c: c["cobrade_codes"]))
    rules = {
        "schema_version": F.col("schema_version") != pf.SCHEMA_VERSION,
        "universe": F.col("territorial_universe.id") != pf.UNIVERSE,
        "municipality_count": F.col("territorial_universe.municipality_count") != expected_units,
        "event_years": atlas["first_year"].isNull() | atlas["latest_year"].isNull(),
        "panel_years": panel["first_year"].isNull() | panel["latest_year"].isNull(),
        "five_types": F.size(atlas["catalog"]) != len(ev.RAIN_CATALOGUE),
        "twelve_codes": (F.size(codes) != len(ev.RAIN_CODES)) | (F.size(F.array_distinct(codes)) != len(ev.RAIN_CODES)),
        **{f"{s}_release": F.col(f"sources.{s}.release").isNull() for s in ("ibge", "atlas", "mapbiomas", "munic")}}
    broken = F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()])
    return meta.select(F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"))


def publish_profiles(spark: SparkSession, layout: Layout, legacy: DataFrame, output: str,
                     max_bytes: int = pf.MAX_SHARD_BYTES, expected_units: int | None = None,
                     verify: bool = True) -> dict:
    """Write shards, index and metadata below ``output``; returns counts."""
    runs = verify_inputs(spark, layout) if verify else None
    tables = {k: published(spark, layout, name) for k, name in INPUTS.items()}
    return export_profiles(tables, legacy, output, max_bytes, expected_units, runs)


def export_profiles(tables: dict[str, DataFrame], legacy: DataFrame, output: str,
                    max_bytes: int = pf.MAX_SHARD_BYTES, expected_units: int | None = None,
                    runs: dict | None = None) -> dict:
    """Write the site's data below ``output``: profiles, shard files, index and metadata.

    Everything is written to a staging folder, read back and checked there; the published folder is
    replaced only if all checks hold.
    """
    dim = tables["dim"]
    stats = dim.agg(F.count("*").alias("n"), F.countDistinct("codigo_ibge").alias("d")).first()
    if stats.n != stats.d:
        raise ContractError("the unit dimension has a repeated code")
    if expected_units is not None and stats.n != expected_units:
        raise ContractError(f"{stats.n} units, expected {expected_units}")
    repeated = legacy.groupBy("code").count().filter("count > 1")
    if not repeated.isEmpty():
        raise ContractError("the legacy listing has a repeated code")
    result = {"municipalities": stats.n}

    def build(root: str) -> None:
        result["shards"] = _stage_site(root, tables, legacy, max_bytes)
        if runs is not None:
            meta = metadata(dim, tables["fact"], tables["history"], runs)
            meta.write.option("ignoreNullFields", "false").json(f"{root}/metadata")
            if wrong := [r["rule"] for r in metadata_problems(meta, stats.n).collect()]:
                raise ContractError(f"metadata breaks its contract: {wrong}")

    replace_on_success(dim.sparkSession, output.rstrip("/"), build)
    return result


def _stage_site(root: str, tables: dict[str, DataFrame], legacy: DataFrame, max_bytes: int) -> int:
    """Profiles, shard files and index below ``root``, checked as written; the number of shards."""
    spark = tables["dim"].sparkSession
    write_parquet(profiles.unit_profiles(**tables, legacy=legacy), f"{root}/profiles")
    assembled = spark.read.parquet(f"{root}/profiles")
    broken = profiles.document_violations(assembled).groupBy("rule").count().collect()  # one row per rule
    if broken:
        raise ContractError("documents break the contract: " + ", ".join(
            f"{r['rule']} ({r['count']})" for r in broken))

    encoded = profiles.encode(assembled)
    write_parquet(profiles.plan_shards(encoded, max_bytes), f"{root}/shard_plan")
    plan = spark.read.parquet(f"{root}/shard_plan")
    placed = encoded.join(plan.select("codigo_ibge", "file"), "codigo_ibge")
    bodies = shard_documents(placed, "uf", "codigo_ibge", "document", "file", pf.SCHEMA_VERSION)
    write_named_texts(bodies, f"{root}{SHARD_ROOT}", "file", "body")
    write_json_lines(profiles.index_entries(encoded, plan, SHARD_ROOT), f"{root}/index")

    # From here on only what lies in the staging folder counts.
    identity = encoded.schema["municipality"].dataType
    held = read_shard_documents(spark, f"{root}{SHARD_ROOT}", identity)
    index = spark.read.schema(StructType([*identity.fields, StructField("shard", StringType())])).json(f"{root}/index")
    problems = profiles.index_problems(index, held.select(
        "codigo_ibge", "municipality", F.concat(F.lit(SHARD_ROOT), F.col("file")).alias("shard"))).first().asDict()
    files = held.groupBy("file").agg(
        F.max("bytes").alias("bytes"), F.count_if(F.col("schema_version") != pf.SCHEMA_VERSION).alias("version"),
        F.count_if(F.col("codigo_ibge").isNull() | F.col("municipality").isNull()).alias("unreadable"),
        F.count_if(~F.col("uf").eqNullSafe(F.col("municipality.uf"))).alias("state"))
    counts = files.agg(
        F.count("*").alias("files"), F.count_if(F.col("bytes") > max_bytes).alias("files_too_large"),
        F.sum("version").alias("other_version"), F.sum("unreadable").alias("unreadable_documents"),
        F.sum("state").alias("documents_of_other_state")).first().asDict()
    shards = counts.pop("files")
    if any(problems.values()) or any(counts.values()):
        raise ContractError(f"index and shards disagree: {problems | counts}")
    return shards
