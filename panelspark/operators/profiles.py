"""Nested per-unit profiles: sections, contract, encoding, shards and index.

Every section is aggregated to one row per unit before the sections are joined on the unit key,
so the joins carry one row per unit and arrays bounded by years, months and types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from panelspark.functions import states as st
from panelspark.functions.numbers import json_number, percentage
from panelspark.operators import benchmark as bm
from panelspark.operators.events import region_yearly_average, type_breakdown, yearly_counts
from panelspark.operators.panel import hide_missing_references
from panelspark.operators.shards import (document_overhead, entry_bytes, pack_shards, shard_name)
from panelspark.presets import events as ev, panel as pn, profiles as pf, survey as sv, units as un

UNIT = "codigo_ibge"
IMPACTS = ("deaths", "injured", "homeless", "displaced", "missing", "reported_affected_total")
TYPE_MEASURES = ("event_count", *IMPACTS, "recognized_event_count")
TOTAL = -1  # type id of the total series inside Spark; published as null


def record(**fields: Column) -> Column:
    """A struct with its fields in alphabetical order, as published."""
    return F.struct(*[fields[k].alias(k) for k in sorted(fields)])


def catalogue(spark) -> DataFrame:
    rows = [(i, name, list(codes)) for i, name, codes in ev.RAIN_CATALOGUE]
    return spark.createDataFrame(rows, "atlas_type_id int, type_name string, cobrade_codes array<string>")


def flagged_events(fact: DataFrame) -> DataFrame:
    """Rain-related events; a code whose type contradicts the catalogue is an error."""
    pairs = [F.lit(x) for i, _, codes in ev.RAIN_CATALOGUE for c in codes for x in (c, i)]
    official = F.try_element_at(F.create_map(*pairs), F.col("cobrade_code"))
    checked = F.when(official == F.col("atlas_type_id"), official).otherwise(F.raise_error(F.concat(
        F.lit("event outside the type catalogue: "), F.coalesce(F.col("cobrade_code"), F.lit("null")))))
    return fact.filter("is_rain_related").withColumn("atlas_type_id", checked)


def types_section(dim: DataFrame, types: DataFrame, rain: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Per unit the five catalogue types, most frequent first, and the impact totals."""
    extra = rain.groupBy(UNIT, "cobrade_code", "atlas_type_id").agg(
        F.count_if("is_federally_recognized").alias("recognized_event_count"),
        F.sum("missing").alias("missing"))
    by_code = types.drop("missing").join(extra, [UNIT, "cobrade_code"])
    totals = snapshot.select(UNIT, F.col("rain_related_event_count").alias("total"))
    rows = type_breakdown(dim, by_code, UNIT, "atlas_type_id", catalogue(dim.sparkSession),
                          TYPE_MEASURES, totals=totals)
    item = F.struct((-F.col("event_count")).alias("n"), F.col("atlas_type_id").alias("i"),
                    record(**{c: F.col(c) for c in rows.columns}).alias("item"))
    return rows.groupBy(UNIT).agg(
        F.transform(F.sort_array(F.collect_list(item)), lambda e: e["item"]).alias("types"),
        *[F.sum(c).alias(f"total_{c}") for c in TYPE_MEASURES],
        F.min("first_event_date").alias("rain_first"), F.max("latest_event_date").alias("rain_latest"))


def months_section(dim: DataFrame, months: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Per unit twelve ordered months; a repeated month is an error.

    The observed months of a unit travel as one small map; the twelve entries are made from it
    without a row per unit and month.
    """
    once = months.groupBy(UNIT, F.col("month").cast("int").alias("month")).agg(
        F.count("*").alias("rows"), F.sum("event_count").alias("events"),
        F.sum("rain_related_event_count").alias("rain"))
    repeated = F.raise_error(F.concat(F.lit("month profile repeated for "), F.col(UNIT)))
    observed = once.groupBy(UNIT).agg(F.map_from_entries(F.collect_list(F.struct(
        "month", F.when(F.col("rows") == 1, F.struct("events", "rain")).otherwise(repeated)))).alias("observed"))
    rows = (dim.select(UNIT).join(observed, UNIT, "left").join(
        snapshot.select(UNIT, F.col("rain_related_event_count").alias("total")), UNIT, "left"))

    def entry(month):
        seen = F.try_element_at("observed", month)
        rain = F.coalesce(seen["rain"], F.lit(0))
        return record(month=month, event_count=F.coalesce(seen["events"], F.lit(0)),
                      rain_related_event_count=rain, event_pct=percentage(rain, F.col("total")))

    return rows.select(UNIT, F.transform(F.sequence(F.lit(1), F.lit(12)), entry).alias("months"))


def annual_section(dim: DataFrame, rain: DataFrame) -> DataFrame:
    """Per unit the total and per-type yearly series with the region's average.

    The dense series exist once per region; a unit adds its own counts from a map, so nothing
    is shuffled per unit, year and type except the observed counts.
    """
    region = "codigo_regiao_imediata"
    averages = region_yearly_average(dim, rain, UNIT, region, "event_year", "atlas_type_id",
                                     ev.RAIN_TYPE_IDS, TOTAL)
    per_type = averages.groupBy(region, "type").agg(
        F.sort_array(F.collect_list(F.struct("year", "average"))).alias("points"),
        F.min("year").alias("lo"), F.max("year").alias("hi"), F.max("members").alias("members"))
    per_region = per_type.groupBy(region).agg(
        F.sort_array(F.collect_list(F.struct("type", "points"))).alias("dense"),
        F.min("lo").alias("first_year"), F.max("hi").alias("latest_year"),
        F.max("members").alias("members"))
    own = yearly_counts(rain, UNIT, "event_year", "atlas_type_id", TOTAL).groupBy(UNIT).agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("type", "year"), "n"))).alias("own"))
    joined = dim.select(UNIT, region).join(per_region, region).join(own, UNIT, "left")

    def one_series(series):
        def point(p):
            key = F.struct(series["type"].alias("type"), p["year"].alias("year"))
            return record(year=p["year"], immediate_region_average_event_count=p["average"],
                          municipal_event_count=F.coalesce(F.try_element_at("own", key), F.lit(0)))

        return record(atlas_type_id=F.nullif(series["type"], F.lit(TOTAL)),
                      points=F.transform(series["points"], point))

    return joined.select(UNIT, "first_year", "latest_year", "members",
                         F.transform("dense", one_series).alias("series"))


HISTORY = ("year", "mapped_area_ha", "urban_area_ha", "urban_area_pct", "native_vegetation_area_ha",
           "native_vegetation_area_pct", "agriculture_livestock_area_ha",
           "agriculture_livestock_area_pct", "water_area_ha", "water_area_pct", "wetland_area_ha",
           "wetland_area_pct")


def land_cover_section(dim: DataFrame, history: DataFrame, change: DataFrame) -> DataFrame:
    """Ordered history and the change row, which a covered unit must have."""
    item = F.struct(F.col("year").alias("y"), record(
        **{c: json_number(F.col(c).cast("double")) if c != "year" else F.col(c)
           for c in HISTORY}, codigo_ibge=F.col(UNIT)).alias("item"))
    grouped = history.groupBy(UNIT).agg(F.transform(
        F.sort_array(F.collect_list(item)), lambda e: e["item"]).alias("history"))
    fields = [c for c in change.columns if c != UNIT]
    joined = grouped.join(change, UNIT, "left")
    years = F.transform("history", lambda h: h["year"])
    shown = hide_missing_references(joined, years)
    covered = F.when(F.col("first_year").isNotNull(), record(**{c: F.col(c) for c in fields})).otherwise(
        F.raise_error(F.concat(F.lit("change row missing for "), F.col(UNIT))))
    return dim.select(UNIT).join(shown.select(UNIT, "history", covered.alias("change")), UNIT, "left")


def benchmark_section(dim: DataFrame, snapshot: DataFrame, history: DataFrame, change: DataFrame) -> DataFrame:
    """The five peer comparisons of each unit inside its immediate region."""
    region = "codigo_regiao_imediata"
    panel = bm.panel_metric_states(
        dim.select(UNIT, region), history, change, UNIT, pf.SHARE_METRICS, pf.CHANGE_METRICS,
        "reference_year_20y")
    counts = snapshot.select(UNIT, F.col(pf.EVENT_METRIC).cast("double").alias("__count"))
    wide = panel.join(counts, UNIT, "left")
    metrics = {pf.EVENT_METRIC: (F.coalesce(F.col("__count"), F.lit(0.0)), F.lit(bm.INCLUDED))}
    for c in (*pf.CHANGE_METRICS, *pf.SHARE_METRICS):
        metrics[c] = (F.col(c), F.col(f"{c}_state"))
    compared = bm.peer_benchmark(bm.metric_rows(wide, UNIT, region, metrics), UNIT, region)
    summary = record(
        municipality_value=F.col("value"), mean=F.col("mean"), median=F.col("median"),
        percentile_strictly_lower_pct=F.col("pct_strictly_lower"),
        denominator=record(included=F.col("included"), missing=F.col("missing"),
                           undefined=F.col("undefined")))
    by_metric = compared.groupBy(UNIT).agg(
        F.map_from_entries(F.collect_list(F.struct("metric", summary))).alias("m"),
        F.max("group_size").alias("municipality_count"))
    dates = snapshot.agg(F.when(F.countDistinct("reference_date") == 1, F.max("reference_date")).otherwise(
        F.raise_error(F.lit("snapshot reference dates differ")))).scalar()
    years = wide.select(UNIT, "latest_snapshot_year", "reference_year_20y")
    joined = by_metric.join(years, UNIT)

    def entry(metric: str, source: str, unit: str, reference: Column) -> Column:
        row = F.element_at("m", F.lit(metric))
        return record(source=F.lit(source), unit=F.lit(unit), reference=reference,
                      **{f: row[f] for f in ("municipality_value", "mean", "median",
                                             "percentile_strictly_lower_pct", "denominator")})

    share_ref = record(latest_snapshot_year=F.col("latest_snapshot_year"))
    change_ref = record(latest_snapshot_year=F.col("latest_snapshot_year"),
                        reference_year_20y=F.when(F.col("latest_snapshot_year").isNotNull(),
                                                  F.col("reference_year_20y")))
    event_ref = record(window_years=F.lit(pf.WINDOW_YEARS), reference_date=dates.cast("string"))
    entries = {pf.EVENT_METRIC: entry(pf.EVENT_METRIC, pf.EVENT_SOURCE, pf.EVENT_UNIT, event_ref)}
    for c in pf.CHANGE_METRICS:
        entries[c] = entry(c, pf.PANEL_SOURCE, pf.PANEL_UNIT, change_ref)
    for c in pf.SHARE_METRICS:
        entries[c] = entry(c, pf.PANEL_SOURCE, pf.PANEL_UNIT, share_ref)
    return joined.select(UNIT, "municipality_count", record(**entries).alias("metrics"))


def summary_text(name: Column, state: Column, count: Column, first: Column, latest: Column,
                 main_type: Column, history: Column) -> Column:
    """The opening sentence, from published values only."""
    year = lambda day: F.substring(day.cast("string"), 1, 4)
    word = F.when(count == 1, pf.RECORD_WORDS[0]).otherwise(pf.RECORD_WORDS[1])
    text = F.concat(
        F.format_string(pf.FOUND_TEXT, year(first), count.cast("bigint"), word, name),
        F.coalesce(F.format_string(pf.TYPE_TEXT, F.nullif(main_type, F.lit(""))), F.lit("")),
        F.coalesce(F.when(latest.isNotNull(), F.format_string(pf.LATEST_TEXT, year(latest))), F.lit("")))
    old, new = F.get(history, F.lit(0)), F.get(history, F.size(history) - 1)
    area = F.format_string(pf.AREA_TEXT, old["urban_area_ha"] / 100, old["year"],
                           new["urban_area_ha"] / 100, new["year"])
    has_area = ((F.size(history) >= 2) & old["urban_area_ha"].isNotNull()
                & new["urban_area_ha"].isNotNull())
    return F.when(state == "no_record", pf.NO_RECORD_TEXT).otherwise(
        F.concat(text, F.when(F.coalesce(has_area, F.lit(False)), area).otherwise(F.lit(""))))


def unit_profiles(dim: DataFrame, snapshot: DataFrame, types: DataFrame, months: DataFrame,
                  fact: DataFrame, history: DataFrame, change: DataFrame, survey: DataFrame,
                  legacy: DataFrame) -> DataFrame:
    """One row per unit with the ten published sections as nested columns.

    ``legacy`` holds code, census struct and transfers struct (null: no transfers).
    """
    identity = dim.select(UNIT, "municipio", "municipio_normalized", F.col("sigla_uf").alias("uf"),
                          "regiao", "regiao_imediata", "codigo_regiao_imediata",
                          "tipo_unidade_territorial")
    rain = flagged_events(fact)
    snap = snapshot.select(UNIT, F.col("event_count").alias("all_events"),
                           F.col("rain_related_event_count").alias("rain_events"),
                           F.lit(True).alias("__snapshot"))
    old = legacy.select(F.col("code").alias(UNIT), "census", F.col("transfers").alias("old_transfers"),
                        F.lit(True).alias("__legacy"))
    answers = survey.select(UNIT, "in_source", "source_year",
                            *[f"{i}_status" for i in sv.PUBLISHED_INDICATORS], F.lit(True).alias("__survey"))
    annual = annual_section(dim, rain).withColumnsRenamed(
        {"first_year": "annual_first", "latest_year": "annual_latest", "members": "annual_members"})
    wide = (identity.join(snap, UNIT, "left").join(types_section(dim, types, rain, snapshot), UNIT)
            .join(months_section(dim, months, snapshot), UNIT).join(annual, UNIT, "left")
            .join(land_cover_section(dim, history, change), UNIT, "left")
            .join(benchmark_section(dim, snapshot, history, change), UNIT, "left")
            .join(answers, UNIT, "left").join(old, UNIT, "left"))
    needed = lambda c, flag, what: F.when(F.col(flag), F.col(c)).otherwise(
        F.raise_error(F.concat(F.lit(f"{what} missing for "), F.col(UNIT))))
    count = needed("rain_events", "__snapshot", "snapshot")
    state = st.events_state(count)
    no_history = F.coalesce(F.col("history"), F.array().cast(wide.schema["history"].dataType))
    cover_state = st.coverage_state(F.size(no_history))
    survey_state = st.source_state(needed("in_source", "__survey", "survey row"))
    census = F.col("census")
    census_state = st.published_state(F.col("__legacy"), census["connectedSewerPct"],
                                      census["outsideSelectedSewerPct"])
    transfer_state = st.optional_state(F.col("__legacy"), F.col("old_transfers"))
    when_record = lambda c: F.when(state == "record", c.cast("string"))
    region = record(codigo=F.col("codigo_regiao_imediata"), nome=F.col("regiao_imediata"),
                    municipality_count=F.col("annual_members"), zeros_policy=F.lit(pf.ZEROS_POLICY))
    disasters = record(
        state=state, types=F.col("types"), months=F.col("months"),
        highlights=F.array().cast("array<string>"),
        history=record(
            state=state, record_scope=F.lit(pf.RECORD_SCOPE), all_event_count=F.col("all_events"),
            rain_related_event_count=count, recognized_event_count=F.col("total_recognized_event_count"),
            first_event_date=when_record(F.col("rain_first")),
            latest_event_date=when_record(F.col("rain_latest")),
            human_impacts=record(**{i: F.col(f"total_{i}") for i in IMPACTS}),
            annual=record(first_year=F.col("annual_first"), latest_year=F.col("annual_latest"),
                          benchmark=record(immediate_region=region), series=F.col("series"))))
    summary = record(
        territorial_universe=F.lit(pf.UNIVERSE),
        thirty_second_text=summary_text(
            F.col("municipio"), state, count, F.col("rain_first"), F.col("rain_latest"),
            F.get("types", F.lit(0))["type_name"], no_history),
        source_states=record(ibge=F.lit("record"), atlas=state, mapbiomas=cover_state,
                             munic=survey_state, census=census_state, transferegov=transfer_state))
    indicators = record(**{i: F.col(f"{i}_status") for i in sv.PUBLISHED_INDICATORS})
    return wide.select(
        UNIT, "uf",
        record(codigo_ibge=F.col(UNIT), **{c: F.col(c) for c in un.IDENTITY if c != UNIT}).alias("municipality"),
        summary.alias("summary"), disasters.alias("disasters"),
        record(state=cover_state, history=no_history, change=F.col("change")).alias("land_cover"),
        record(state=survey_state, provenance=F.lit(pf.SURVEY_PROVENANCE),
               reference_year=F.col("source_year"), indicators=indicators).alias("municipal_capacity"),
        record(state=census_state, provenance=F.lit(pf.LEGACY_PROVENANCE), year=census["year"],
               connected_sewer_pct=census["connectedSewerPct"],
               outside_selected_sewer_pct=census["outsideSelectedSewerPct"]).alias("census"),
        record(state=transfer_state, provenance=F.lit(pf.LEGACY_PROVENANCE),
               legacy=F.col("old_transfers")).alias("transfers"),
        record(immediate_region=record(
            codigo=F.col("codigo_regiao_imediata"), nome=F.col("regiao_imediata"),
            municipality_count=F.col("municipality_count"),
            includes_selected_municipality=F.lit(True), metrics=F.col("metrics"))).alias("benchmarks"),
        F.array(*[F.lit(s) for s in pf.SOURCES]).alias("sources"),
        F.lit(pf.SCHEMA_VERSION).alias("schema_version"))


SECTIONS = ("benchmarks", "census", "disasters", "land_cover", "municipal_capacity", "municipality",
            "schema_version", "sources", "summary", "transfers")


def encode(profiles: DataFrame) -> DataFrame:
    """Unit, state and the compact JSON document, nulls kept, fields in alphabetical order."""
    return profiles.select(UNIT, "uf", "municipality", F.to_json(
        F.struct(*SECTIONS), {"ignoreNullFields": "false"}).alias("document"))


def document_rules() -> dict[str, Column]:
    """Name to violation condition of the published document contract."""
    d, lc, mc = F.col("disasters"), F.col("land_cover"), F.col("municipal_capacity")
    history, annual = d["history"], d["history"]["annual"]
    years = F.sequence(annual["first_year"], annual["latest_year"])
    series, count = annual["series"], history["rain_related_event_count"]
    total_at = lambda items, field: F.aggregate(
        items, F.lit(0).cast("double"), lambda acc, i: acc + F.coalesce(i[field], F.lit(0)).cast("double"))
    ids = F.array(*[F.lit(i) for i in ev.RAIN_TYPE_IDS])
    counts_of = lambda s: F.transform(s["points"], lambda p: p["municipal_event_count"])
    totals = F.filter(series, lambda s: s["atlas_type_id"].isNull())
    per_type = F.filter(series, lambda s: s["atlas_type_id"].isNotNull())
    # Position-wise sum over the type series must equal the total series.
    zeros = F.transform(years, lambda y: F.lit(0).cast("bigint"))
    summed = F.aggregate(F.transform(per_type, counts_of), zeros,
                         lambda acc, c: F.zip_with(acc, c, lambda a, b: a + b))
    region = F.col("benchmarks")["immediate_region"]
    indicators = [mc["indicators"][i] for i in sv.PUBLISHED_INDICATORS]
    rules = {
        "schema_version": F.col("schema_version") != pf.SCHEMA_VERSION,
        "unit_code": ~F.col("municipality")["codigo_ibge"].rlike(r"\A[0-9]{7}\z"),
        "identity_complete": ~_all([F.col("municipality")[c].isNotNull() for c in un.IDENTITY]),
        "summary_text": F.coalesce(F.col("summary")["thirty_second_text"], F.lit("")) == "",
        "annual_series_ids": ~((F.size(totals) == 1) & (F.sort_array(
            F.transform(per_type, lambda s: s["atlas_type_id"])).eqNullSafe(ids))),
        "annual_years_contiguous": ~F.forall(series, lambda s: F.transform(
            s["points"], lambda p: p["year"]).eqNullSafe(years)),
        "annual_totals": ~summed.eqNullSafe(counts_of(F.get(totals, F.lit(0)))),
        "five_types": ~F.sort_array(F.transform(d["types"], lambda t: t["atlas_type_id"])).eqNullSafe(ids),
        "type_pct_present": ~F.forall(d["types"], lambda t: t["event_pct"].isNotNull()),
        "type_counts": total_at(d["types"], "event_count") != count,
        "twelve_months": ~F.transform(d["months"], lambda m: m["month"]).eqNullSafe(
            F.sequence(F.lit(1), F.lit(12))),
        "month_pct_null_without_events": (count == 0) & F.exists(
            d["months"], lambda m: m["event_pct"].isNotNull()),
        "no_coverage_is_empty": (lc["state"] == "no_coverage") & (
            (F.size(lc["history"]) > 0) | lc["change"].isNotNull()),
        "coverage_has_change": (lc["state"] == "record") & (
            (F.size(lc["history"]) == 0) | lc["change"].isNull()),
        "survey_record": (mc["state"] == "record") & _any([i == "not_in_source" for i in indicators]),
        "survey_absent": (mc["state"] == "not_in_source") & _any([i != "not_in_source" for i in indicators]),
        "survey_states": _any([~i.isin(*st.GOLD_STATES) for i in indicators]),
        "survey_year": mc["reference_year"] != sv.REFERENCE_YEAR,
        "benchmark_size": F.coalesce(region["municipality_count"], F.lit(0)) < 1,
    }
    for section in ("disasters", "land_cover", "municipal_capacity", "census", "transfers"):
        rules[f"{section}_state"] = ~F.col(section)["state"].isin(*st.SECTION_STATES)
    for impact in IMPACTS:
        rules[f"impact_{impact}"] = total_at(d["types"], impact) != history["human_impacts"][impact]
    for h in pn.HORIZONS:
        reference = lc["change"][f"reference_year_{h}y"]
        rules[f"reference_{h}y_in_history"] = reference.isNotNull() & ~F.array_contains(
            F.transform(lc["history"], lambda r: r["year"]), reference)
    for metric in (pf.EVENT_METRIC, *pf.CHANGE_METRICS, *pf.SHARE_METRICS):
        m = region["metrics"][metric]
        parts = [m["denominator"][s] for s in (bm.INCLUDED, bm.MISSING, bm.UNDEFINED)]
        rules[f"denominator_{metric}"] = (parts[0] + parts[1] + parts[2]) != region["municipality_count"]
        rules[f"empty_{metric}"] = (parts[0] == 0) & (
            m["mean"].isNotNull() | m["median"].isNotNull() | m["percentile_strictly_lower_pct"].isNotNull())
    return rules


def _all(conditions):
    result = F.lit(True)
    for c in conditions:
        result = result & c
    return result


def _any(conditions):
    result = F.lit(False)
    for c in conditions:
        result = result | F.coalesce(c, F.lit(False))
    return result


def _broken_rules() -> Column:
    """The names of the broken rules of one document; null conditions count as broken."""
    broken = F.array(*[F.when(F.coalesce(condition, F.lit(name not in _NULL_IS_FINE)), F.lit(name))
                       for name, condition in document_rules().items()])
    return F.filter(broken, lambda r: r.isNotNull())


def document_violations(profiles: DataFrame) -> DataFrame:
    """(unit, rule) for every broken rule of the document contract."""
    return profiles.select(UNIT, F.explode(_broken_rules()).alias("rule"))


def encoded_violations(encoded: DataFrame, schema: StructType) -> DataFrame:
    """(unit, rule) for every broken rule, judged on the encoded documents as published, in one pass.

    ``encoded`` has the unit and ``document``; ``schema`` is that of the ten sections.  A text that is
    not JSON breaks ``readable`` alone; a section that is absent or null breaks ``section_<name>``
    besides the rules that need it.
    """
    read = lambda s: F.try_variant_get("v", f"$.{s}", "variant")
    absent = F.array(*[F.when(F.coalesce(F.is_variant_null(read(s)), F.lit(True)) | read(s).isNull(), F.lit(f"section_{s}"))
                       for s in SECTIONS])
    parsed = encoded.select(UNIT, F.try_parse_json("document").alias("v"), "document")
    decoded = parsed.select(UNIT, F.col("v").isNotNull().alias("readable"),
                            F.filter(absent, lambda r: r.isNotNull()).alias("absent"),
                            F.from_json(F.when(F.col("v").isNotNull(), F.col("document")), schema).alias("d"))
    return decoded.select(UNIT, "readable", "absent", "d.*").select(UNIT, F.explode(
        F.when(F.col("readable"), F.concat("absent", _broken_rules())).otherwise(F.array(F.lit("readable")))).alias("rule"))


#: Rules whose condition is null by design for units without coverage.
_NULL_IS_FINE = {f"reference_{h}y_in_history" for h in pn.HORIZONS}


def plan_shards(encoded: DataFrame, max_bytes: int = pf.MAX_SHARD_BYTES, **spread) -> DataFrame:
    """Unit, state, shard file name, part and parts."""
    sized = encoded.select("uf", UNIT, entry_bytes(F.col(UNIT), F.col("document")).alias("bytes"))
    packed = pack_shards(sized, "uf", UNIT, "bytes", max_bytes,
                         document_overhead(F.col("uf"), pf.SCHEMA_VERSION), **spread)
    return packed.withColumn("file", shard_name(F.col("uf"), F.col("part"), F.col("parts")))


def index_entries(encoded: DataFrame, shards: DataFrame, root: str = "/data/v1/uf/") -> DataFrame:
    """Identity of every unit with the path of its shard."""
    return encoded.join(shards.select(UNIT, "file"), UNIT).select(
        "municipality.*", F.concat(F.lit(root), F.col("file")).alias("shard"))


def index_problems(index: DataFrame, documents: DataFrame) -> DataFrame:
    """One row of counters over index and shard documents; all zero when they reconcile.

    ``documents`` has the unit key, its shard path and the identity struct ``municipality``.
    """
    left = index.groupBy(UNIT).agg(
        F.count("*").alias("i_n"), F.min("shard").alias("i_shard"), F.min("uf").alias("i_uf"),
        F.min(F.struct(*un.IDENTITY)).alias("i_identity"))
    right = documents.groupBy(UNIT).agg(
        F.count("*").alias("d_n"), F.min("shard").alias("d_shard"),
        F.min(F.struct(*[F.col(f"municipality.{c}").alias(c) for c in un.IDENTITY])).alias("d_identity"))
    both = left.join(right, UNIT, "full")
    shape = r"\A.*/([A-Z]{2})(?:-[0-9]{3,})?\.json\z"
    return both.agg(
        F.count_if(F.col("i_n") > 1).alias("repeated_in_index"),
        F.count_if(F.col("d_n") > 1).alias("repeated_in_shards"),
        F.count_if(F.col("d_n").isNull()).alias("missing_documents"),
        F.count_if(F.col("i_n").isNull()).alias("orphan_documents"),
        F.count_if(F.col("i_shard") != F.col("d_shard")).alias("wrong_shard"),
        F.count_if(F.col("i_n").isNotNull() & (F.regexp_extract("i_shard", shape, 1) != F.col("i_uf")))
        .alias("shard_of_other_state"),
        F.count_if(~F.col("i_identity").eqNullSafe(F.col("d_identity")) & F.col("i_n").isNotNull()
                   & F.col("d_n").isNotNull()).alias("identity_differs"))
