"""End-to-end runs of the four sources and the profile export on small landed files."""

import datetime as dt
import json

import gold
import pytest
from pyspark.sql import functions as F

from panelspark.operators import conform, keys
from panelspark.operators.release import StaleOutput
from panelspark.plans import consumer, events as ev_plan, panel as pn_plan, publish, survey as sv_plan, units as un_plan
from panelspark.plans.runner import Layout, previous_run, published
from panelspark.presets import events as ev, panel as pn, survey as sv
from panelspark.quality.checks import QualityFailure

STATES = {"SC": (42, "Santa Catarina", 4, "Sul"), "AC": (12, "Acre", 1, "Norte"), "PE": (26, "Pernambuco", 2, "Nordeste")}
TERRITORY = [("4202404", "Blumenau", "SC", 420010), ("4209102", "Joinville", "SC", 420010),
             ("1200013", "Acrelândia", "AC", 120001), ("2605459", "Fernando de Noronha", "PE", 260001)]
STAMP = dt.datetime(2026, 9, 1)


def territory(path):
    rows = []
    for code, name, uf, immediate in TERRITORY:
        number, state, region, region_name = STATES[uf]
        rows.append({"id": int(code), "nome": name, "microrregiao": None, "regiao-imediata": {
            "id": immediate, "nome": f"Região {immediate}", "regiao-intermediaria": {
                "id": immediate // 100, "nome": "Inter", "UF": {"id": number, "sigla": uf, "nome": state, "regiao": {
                    "id": region, "sigla": region_name[0], "nome": region_name}}}}})
    path.write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    return str(path)


def event(code, day, cobrade="12200", kind="2.0", status="Registro", **values):
    names = {"12200": ("Enxurradas", "Hidrológico"), "14120": ("Seca", "Climatológico")}
    row = {s: "0" if k in ("count", "money") else "" for s, _, k in ev.FIELDS}
    row.update({"Protocolo_S2iD": f"SC-F-{code}-{cobrade}-{day[6:]}{day[3:5]}{day[:2]}", "Nome_Municipio": "Nome",
                "Sigla_UF": "SC", "regiao": "Sul", "Data_Registro": "31/12/2025", "Data_Evento": day,
                "Cod_Cobrade": cobrade, "tipologia": kind, "descricao_tipologia": names[cobrade][0],
                "grupo_de_desastre": names[cobrade][1], "Cod_IBGE_Mun": code, "Status": status})
    row.update(values)
    return row


def default_events():
    harm = {"DH_MORTOS": "2", "DH_FERIDOS": " 3 ", "DH_total_danos_humanos_diretos": "5", "DH_OUTROS AFETADOS": "10"}
    return [
        event("4202404", "28/02/2016", **harm), event("4202404", "29/02/2016", status="Reconhecido"),
        event("4202404", "05/01/2024", "14120", "5.0", DH_Descricao='Água; "quebra"\nde linha — fim'),
        event("4209102", "28/02/2026", Protocolo_S2iD="bad-protocol", Data_Registro="01/01/2026"),
        event("1200013", "07/03/1991", "14120", "5.0", **{
            "DM_Uni Habita Valor": "10.00", "DM_total_danos_materiais": "10.04", "Nome_Municipio": "Outro"}),
    ]


def write_csv(path, rows):
    import csv
    import io

    out = io.StringIO()
    writer = csv.DictWriter(out, ev.EVENT_CONTRACT.fields, delimiter=";", lineterminator="\n")
    writer.writeheader()
    writer.writerows(rows)
    path.write_bytes(out.getvalue().encode("cp1252"))
    return str(path)


def landed(spark, path, rows):
    columns = list(rows[0])
    spark.createDataFrame([tuple(r[c] for c in columns) for r in rows],
                          ", ".join(f"`{c}` string" for c in columns)).write.mode("overwrite").parquet(str(path))
    return str(path)


TYPE_SHEET = [
    {"Cobrade": "12200.0", "Desastre": "Enxurrada", "Atlas - Descrição Tipologia": "Enxurradas",
     "Atlas N. Tipologia": "2.0", "Grupo de desastres": "Hidrológico"},
    {"Cobrade": "14120", "Desastre": "Seca", "Atlas - Descrição Tipologia": "Seca",
     "Atlas N. Tipologia": "5", "Grupo de desastres": "Climatológico"},
    {"Cobrade": "1331", "Desastre": "Onda", "Atlas - Descrição Tipologia": "Onda", "Atlas N. Tipologia": "9",
     "Grupo de desastres": "Outros"},
    {"Cobrade": None, "Desastre": None, "Atlas - Descrição Tipologia": None, "Atlas N. Tipologia": None,
     "Grupo de desastres": None}]
FACTOR_SHEET = [
    {"Ano Ref": "1992", "igp-di (dezembro)": "...", ev_plan.FACTOR_COLUMN: "0"},
    {"Ano Ref": "2024.0", "igp-di (dezembro)": "1100.5", ev_plan.FACTOR_COLUMN: "1.06"},
    {"Ano Ref": "2025", "igp-di (dezembro)": "1167.239", ev_plan.FACTOR_COLUMN: "1"},
    {"Ano Ref": None, "igp-di (dezembro)": None, ev_plan.FACTOR_COLUMN: None}]


def workbook(rows):
    """The same events as a workbook stores them."""
    copies = []
    for row in rows:
        copy = dict(row)
        for c in ("Data_Registro", "Data_Evento"):
            day = dt.datetime.strptime(row[c], "%d/%m/%Y")
            copy[c] = str((day - dt.datetime(1899, 12, 30)).days + 0.5)
        copy["Cod_Cobrade"], copy["Cod_IBGE_Mun"] = f"{row['Cod_Cobrade']}.0", f"{row['Cod_IBGE_Mun']}.0"
        for s, _, k in ev.FIELDS:
            if k in ("count", "money"):
                copy[s] = str(float(row[s]))
        copy["DH_Descricao"] = row["DH_Descricao"].replace("\n", "_x000D_\n") or None
        copies.append(copy)
    return copies


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("world")
    layout = Layout(str(root / "lake"))
    un_plan.run_units(spark, layout, territory(root / "units.json"), "2026-09", {"json": "h1"},
                      examples=("2605459", "4202404"), source="listing", source_url="file", ingested_at=STAMP)
    return root, layout


def run_events(spark, root, layout, rows, release, copies=True, **more):
    name = f"events-{release}"
    paths = {"csv_path": write_csv(root / f"{name}.csv", rows), "types_path": landed(spark, root / "types", TYPE_SHEET),
             "factors_path": landed(spark, root / "factors", FACTOR_SHEET)}
    if copies:
        paths["original_path"] = landed(spark, root / f"{name}-orig", workbook(rows))
        paths["corrected_path"] = landed(spark, root / f"{name}-corr", workbook(rows))
    years = [int(r["Data_Evento"][6:]) for r in rows]
    return ev_plan.run_events(spark, layout, release=release, first_year=min(years), latest_year=max(years),
                              source_hashes={"csv": f"h-{release}-{len(rows)}"}, **paths, **more)


def test_units_run_publishes_the_dimension(spark, world):
    _, layout = world
    dim = {r.codigo_ibge: r for r in published(spark, layout, "dim_municipality").collect()}
    assert len(dim) == 4 and dim["2605459"].tipo_unidade_territorial == "distrito_estadual"
    assert dim["1200013"].municipio_normalized == "acrelandia"
    run = previous_run(spark, layout, "units")
    assert run["row_counts"]["dim_municipality"] == 4
    report = spark.read.json(layout.report("units"))
    assert report.filter("status = 'FAIL'").isEmpty() and report.count() == 10


def test_events_run_skip_and_release_impact(spark, world):
    root, layout = world
    first = run_events(spark, root, layout, default_events(), "r1")
    assert first["status"] == "SUCCESS"
    silver = {(r.codigo_ibge, str(r.event_date)): r for r in published(spark, layout, "silver_disaster_event").collect()}
    assert len(silver) == 5
    flood = silver["4202404", "2016-02-28"]
    assert (flood.deaths, flood.injured, flood.reported_affected_total, flood.event_month) == (2, 3, 15, 2)
    assert flood.is_rain_related and flood.is_hydrological and flood.is_protocol_format_valid
    assert flood.human_damage_description is None and flood.source_row_number == 1
    assert silver["4202404", "2024-01-05"].human_damage_description == 'Água; "quebra"\nde linha — fim'
    odd = silver["4209102", "2026-02-28"]
    assert not odd.is_protocol_format_valid and not odd.is_protocol_ibge_consistent
    assert odd.is_event_after_registration and odd.monetary_reference_year == 2025
    snapshot = {r.codigo_ibge: r for r in published(spark, layout, "snapshot_municipality_disaster_history").collect()}
    blumenau = snapshot["4202404"]
    assert str(blumenau.reference_date) == "2026-02-28"
    assert (blumenau.event_count, blumenau.rain_related_event_count, blumenau.rain_related_event_count_10y,
            blumenau.event_count_5y) == (3, 2, 1, 1)
    assert snapshot["2605459"].event_count == 0 and snapshot["2605459"].deaths == 0
    assert published(spark, layout, "municipality_disaster_month_profile").count() == 48
    anomalies = ev_plan.event_anomalies(published(spark, layout, "silver_disaster_event")).first()
    assert (anomalies.invalid_protocol_format, anomalies.event_after_registration, anomalies.codes_with_name_variants) == (1, 1, 0)
    types = published(spark, layout, "dim_disaster_type")
    assert {r.cobrade_code for r in keys.unused_members(types, published(spark, layout, "fact_disaster_event"), "cobrade_code").collect()} == {"01331"}

    again = run_events(spark, root, layout, default_events(), "r1")
    assert again["status"] == "NO_CHANGE"
    more = default_events()[1:] + [event("4209102", "01/02/2020")]
    second = run_events(spark, root, layout, more, "r2")
    assert second["status"] == "SUCCESS"
    assert (second["detail"]["event_ids_added"], second["detail"]["event_ids_removed"]) == ("1", "1")
    assert second["detail"]["municipality_codes_added"] == "0"
    archived = spark.read.parquet(layout.history("fact_disaster_event"))
    assert {r.source_release for r in archived.select("source_release").distinct().collect()} == {"r1"}
    assert archived.count() == 5

    # A changed file behind an unchanged signature is noticed.
    published(spark, layout, "fact_disaster_event").limit(2).write.mode("overwrite").parquet(str(root / "tampered"))
    spark.read.parquet(str(root / "tampered")).write.mode("overwrite").parquet(layout.table("fact_disaster_event"))
    with pytest.raises(StaleOutput, match="fact_disaster_event"):
        publish.verify_inputs(spark, layout, ["events"])
    assert run_events(spark, root, layout, more, "r2")["status"] == "SUCCESS"


@pytest.mark.parametrize("change,failing", [
    ({"DH_MORTOS": "-1", "DH_total_danos_humanos_diretos": "-1"}, "counts_and_monetary_values_are_nonnegative"),
    ({"DH_MORTOS": "1"}, "human_impact_totals_reconcile"),
    ({"DM_total_danos_materiais": "0.06"}, "monetary_component_totals_reconcile_with_rounding_tolerance"),
    ({"Status": "Outro"}, "recognition_status_values_are_known"),
    ({"Cod_IBGE_Mun": "9999999"}, "source_municipalities_match_dim_municipality_by_code"),
    ({"descricao_tipologia": "Errado"}, "cobrade_codes_and_classification_match_official_dimension"),
])
def test_failing_checks_block_publication(spark, world, change, failing):
    root, layout = world
    rows = [*default_events(), event("4202404", "03/03/2020", status="Reconhecido", **change)]
    before = [tuple(r) for r in published(spark, layout, "fact_disaster_event").select("disaster_event_id").collect()]
    with pytest.raises(QualityFailure, match=failing):
        run_events(spark, root, layout, rows, "bad", copies=False)
    after = [tuple(r) for r in published(spark, layout, "fact_disaster_event").select("disaster_event_id").collect()]
    assert sorted(before) == sorted(after)
    assert previous_run(spark, layout, "events")["release"] != "bad"


def test_workbook_differences_are_found(spark, world):
    rows = default_events()
    raw = spark.createDataFrame([tuple(r[c] for c in ev.EVENT_CONTRACT.fields) for r in rows], ev.EVENT_CONTRACT.landing_schema())
    copies = workbook(rows)
    copies[0]["DH_MORTOS"], copies[1]["Nome_Municipio"] = "9.0", "Outra"
    book = spark.createDataFrame([tuple(r[c] for c in ev.EVENT_CONTRACT.fields) for r in copies], ev.EVENT_CONTRACT.landing_schema())
    compared = keys.compare_copies(raw, book, "Protocolo_S2iD", conform.workbook_comparators())
    assert compared.filter("not all_fields_match").count() == 2
    counts = keys.mismatch_counts(compared).first()
    assert counts["DH_MORTOS_differences"] == 1 and counts["Nome_Municipio_differences"] == 1 and counts.differing_rows == 2


CLASSES = [(0, "7. Not Observed"), (3, "1. Forest"), (11, "2. Herbaceous and Shrubby Vegetation"), (15, "3. Farming"),
           (24, "4. Non vegetated area"), (33, "5. Water")]
LEGEND = 'class_id,class_name_pt_br,class_name_en,hex_code\n3,Formação Florestal,Forest,#1\n11,"Campo Alagado e Área Pantanosa",Wetland,#2\n' \
         '15,Pastagem,Pasture,#3\n24,Área Urbanizada,Urban,#4\n33,"Rio, Lago e Oceano",Water,#5\n99,Só legenda,Only,#6\n'


def wide_rows(first, last, bump=0.0):
    rows = []
    for unit, biomes in (("4202404", ["Mata", "Pampa"]), ("4209102", ["Mata"]), ("1200013", ["Amazônia"]), ("7777777", ["Mata"])):
        for biome in biomes:
            for class_id, branch in CLASSES:
                for state in (["SC", "PR"] if unit == "4209102" and class_id == 3 else ["SC"]):
                    levels = ["All", branch, branch, f"{branch}.1 leaf" if class_id == 15 else branch]
                    levels.append(levels[-1])
                    values = [None if unit == "1200013" and y == first + 20 and last - y == 20 else
                              100.0 + (class_id + y - first + bump if class_id == 24 else 0.0) - (y - first if class_id == 3 else 0)
                              for y in range(first, last + 1)]
                    if class_id == 24 and unit == "4209102":
                        values[0] = 0.0
                    rows.append((len(rows), "Brasil", biome, "Sul", state, unit, f"Nome {unit}", "Nome-UF", float(class_id), *levels, *values))
    return rows


def wide(spark, root, name, first, last, bump=0.0):
    years = ", ".join(f"y{y} double" for y in range(first, last + 1))
    schema = "ID int, " + ", ".join(f"`{c}` {'double' if c == 'class' else 'string'}" for c in pn.WIDE_PREFIX[1:]) + ", " + years
    df = spark.createDataFrame(wide_rows(first, last, bump), schema)
    df.write.mode("overwrite").parquet(str(root / name))
    return str(root / name)


def test_panel_run_with_change_and_impact(spark, world, monkeypatch):
    root, layout = world
    monkeypatch.setattr(pn, "COVERAGE_THRESHOLD_PCT", 70.0)
    monkeypatch.setattr(pn, "VARIATION_FAILURE_PCT", 100.0)
    (root / "legend.csv").write_text(LEGEND, encoding="utf-8")
    run = lambda release, path, last: pn_plan.run_panel(
        spark, layout, path, str(root / "legend.csv"), release, 2000, last, {"wide": release},
        documented={"urban": 24}, examples=("4202404",))
    assert run("c1", wide(spark, root, "wide1", 2000, 2025), 2025)["status"] == "SUCCESS"
    legend = {r.class_id: r for r in published(spark, layout, "class_legend").collect()}
    assert legend[0].class_name == "Not Observed" and not legend[0].is_mapped_class
    assert legend[0].class_name_source == "statistics_workbook_hierarchy" and legend[99].is_in_statistics is False
    assert legend[15].class_level == 3 and legend[3].class_level == 1 and legend[3].is_native_vegetation
    silver = published(spark, layout, "silver_land_cover")
    double = silver.filter("codigo_ibge = '4209102' and class_id = 3 and year = 2000").first()
    assert (double.area_ha, double.source_row_count, double.source_state_names) == (200.0, 2, ["PR", "SC"])
    assert {r.codigo_ibge for r in consumer.unmatched_units(silver).collect()} == {"7777777"}
    assert [r.codigo_ibge for r in consumer.units_in_several_biomes(silver).collect()] == ["4202404"]
    fact = published(spark, layout, "fact_municipality_land_cover")
    two = fact.filter("codigo_ibge = '4202404' and class_id = 24 and year = 2000").first()
    assert (two.area_ha, two.area_km2) == (248.0, 2.48)
    snapshot = published(spark, layout, "snapshot_municipality_land_cover")
    row = snapshot.filter("codigo_ibge = '4202404' and year = 2025").first()
    assert row.urban_area_ha == 298.0 and row.native_vegetation_area_ha == 350.0
    assert row.mapped_area_ha == 350 + 200 + 298 + 200 and row.wetland_area_ha == 200.0
    assert row.urban_area_pct == pytest.approx(298 / 1048 * 100)
    change = {r.codigo_ibge: r for r in published(spark, layout, "municipality_land_cover_change").collect()}
    assert set(change) == {"4202404", "4209102", "1200013"}
    assert change["4202404"].urban_area_change_ha == 50.0 and change["4202404"].urban_change_10y_ha == 20.0
    assert change["4202404"].urban_change_10y_pct == pytest.approx(20 / 278 * 100)
    assert change["4209102"].urban_area_change_pct is None and change["4209102"].water_area_change_10y_ha == 0.0
    assert consumer.change_ranking(published(spark, layout, "municipality_land_cover_change"),
                                   published(spark, layout, "dim_municipality")).first().codigo_ibge == "4209102"

    # The next collection adds a year, moves the urban area and loses a unit's reference year.
    second = run("c2", wide(spark, root, "wide2", 2000, 2026, bump=2.0), 2026)
    assert second["detail"]["class_ids_added"] == "0" and second["detail"]["year"] == "2025"
    assert float(second["detail"]["urban_area_ha_max_abs_diff"]) == 4.0
    again = run("c2", wide(spark, root, "wide2", 2000, 2026, bump=2.0), 2026)
    assert again["status"] == "NO_CHANGE"
    history = spark.read.parquet(layout.history("snapshot_municipality_land_cover"))
    assert {r.source_release for r in history.select("source_release").distinct().collect()} == {"c1"}


def test_a_missing_reference_year_removes_the_unit(spark):
    from panelspark.operators.panel import ChangeMetric, panel_change

    rows = [("a", y, float(y)) for y in (2000, 2005, 2010)] + [("b", y, 1.0) for y in (2000, 2010)]
    df = spark.createDataFrame(rows, "u string, year int, x double")
    got = panel_change(df, [ChangeMetric("x", "x")], (5,), unit="u").collect()
    assert [(r.u, r.x_change_5y_ha, r.x_change_ha) for r in got] == [("a", 5.0, 10.0)]


@pytest.mark.parametrize("edit,message", [
    (lambda t: t.replace("Área Urbanizada", "Outra"), "Área Urbanizada"),
    (lambda t: t + "24,Repetida,x,#\n", "duplicate class_id"),
    (lambda t: t.replace("24,Área Urbanizada", "98,Área Urbanizada"), "missing from the statistics")])
def test_class_semantics_refuse_unclear_legends(spark, tmp_path, edit, message):
    from panelspark.operators import panel as op
    from panelspark.sources.contracts import ContractError
    from panelspark.sources.readers import read_typed_csv

    (tmp_path / "l.csv").write_text(edit(LEGEND), encoding="utf-8")
    legend = read_typed_csv(spark, str(tmp_path / "l.csv"), pn.LEGEND_CONTRACT)
    frame = spark.read.parquet(wide(spark, tmp_path, "w", 2000, 2001))
    with pytest.raises(ContractError, match=message):
        op.class_semantics(op.class_hierarchy(frame), legend)
    two = frame.withColumn("class_level_1", F.when(F.col("ID") == 1, "8. Other").otherwise(F.col("class_level_1")))
    with pytest.raises(ContractError, match="more than one hierarchy"):
        op.class_hierarchy(two)


def survey_sheet(spark, path, **changes):
    answers = {c: "Não" for c in (*sv.PLANNING_COLUMNS.values(), *sv.DIRECT_COLUMNS.values(), sv.UNKNOWN_COLUMN)}
    rows = []
    for code, uf, name in (("4202404", "SC", "Blumenau"), ("4209102", "SC", "Joinville"), ("1200013", "AC", "Acrelândia")):
        row = {"codmun": code, "UF ": uf, "Mun": name, **answers}
        if code == "4202404":
            row.update({"Mgrd171": "Sim", "Mgrd216": "Sim", "Mgrd225": "-", "Mgrd2213": "-", **changes})
        rows.append(row)
    return landed(spark, path, rows)


def test_survey_run(spark, world):
    root, layout = world
    golden = {"flood_risk_mapping_status": 0}
    record = sv_plan.run_survey(spark, layout, survey_sheet(spark, root / "survey"), "2020", {"xlsx": "s1"}, 3, 4,
                                ["2605459"], golden, source="survey")
    assert record["status"] == "SUCCESS"
    rows = {r.codigo_ibge: r for r in published(spark, layout, "municipality_munic_capacity_2020").collect()}
    blumenau = rows["4202404"]
    assert blumenau.municipal_civil_defense_body_status == "unknown"
    assert blumenau.any_risk_prevention_planning_instrument_status == "declared_yes"
    assert blumenau.civil_defense_budget_provision_status == "not_applicable" and blumenau.in_source
    absent = rows["2605459"]
    assert not absent.in_source and absent.flood_risk_mapping_status == "not_in_source" and absent.source_year == 2020
    with pytest.raises(QualityFailure, match="new_municipalities_are_explicitly_outside"):
        sv_plan.run_survey(spark, layout, survey_sheet(spark, root / "survey2"), "2021", {"xlsx": "s2"}, 3, 4, [], golden)
    with pytest.raises(QualityFailure, match="selected_indicator_counts"):
        sv_plan.run_survey(spark, layout, survey_sheet(spark, root / "survey3"), "2022", {"xlsx": "s3"}, 3, 4, ["2605459"],
                           {"flood_risk_mapping_status": 7})


def test_profiles_are_published_from_the_runs(spark, world):
    root, layout = world
    legacy = spark.createDataFrame([("4202404", (67.6, 32.4, 2022), None)], gold.LEGACY_SCHEMA)
    out = str(root / "published")
    result = publish.publish_profiles(spark, layout, legacy, out, expected_units=4)
    assert result == {"municipalities": 4, "shards": 3}
    docs = {}
    for path in (root / "published/data/v1/uf").glob("*.json"):
        docs |= json.loads(path.read_text(encoding="utf-8"))["municipalities"]
    assert docs["4202404"]["disasters"]["state"] == "record" and docs["4202404"]["land_cover"]["state"] == "record"
    assert docs["2605459"]["land_cover"]["state"] == "no_coverage"
    assert docs["1200013"]["transfers"]["state"] == "not_in_legacy_universe"
    meta = spark.read.json(f"{out}/metadata").first()
    assert meta.sources.atlas.release == "r2" and meta.sources.mapbiomas.latest_year == 2026
    assert meta.territorial_universe.municipality_count == 4
    profile = consumer.integrated_profile(*(published(spark, layout, n) for n in (
        "dim_municipality", "snapshot_municipality_land_cover", "snapshot_municipality_disaster_history")), "2605459").first()
    assert profile.land_cover_year is None and profile.event_count == 0
