import json
from collections import namedtuple
from pathlib import Path

import gold
import pytest
from pyspark.sql import functions as F

from panelspark.operators import profiles
from panelspark.operators.shards import read_shard_documents, shard_documents
from panelspark.plans.publish import export_profiles
from panelspark.sinks.writers import write_named_texts
from panelspark.sources.contracts import ContractError


Line = namedtuple("Line", "file uf codigo_ibge document")


def published_documents(out):
    """The documents in the shard files, read without Spark."""
    lines = []
    for path in sorted(Path(out, "data/v1/uf").glob("*.json")):
        text = path.read_text(encoding="utf-8")
        shard = json.loads(text)
        assert text.endswith("}\n") and list(shard) == ["municipalities", "schema_version", "uf"]
        assert list(shard["municipalities"]) == sorted(shard["municipalities"])
        lines += [Line(path.name, shard["uf"], code, json.dumps(doc)) for code, doc in shard["municipalities"].items()]
    return lines


@pytest.fixture(scope="module")
def exported(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("export"))
    result = export_profiles(gold.gold_tables(spark), gold.legacy(spark), out, expected_units=9)
    lines = published_documents(out)
    return out, result, {r.codigo_ibge: json.loads(r.document) for r in lines}, lines


def test_every_unit_has_its_expected_states(exported):
    _, result, docs, _ = exported
    assert result == {"municipalities": 9, "shards": 9}
    for code, (disasters, cover, census, transfers) in gold.EDGE_STATES.items():
        doc = docs[code]
        assert (doc["disasters"]["state"], doc["land_cover"]["state"], doc["census"]["state"],
                doc["transfers"]["state"]) == (disasters, cover, census, transfers), code
    assert docs["2605459"]["municipality"]["tipo_unidade_territorial"] == "distrito_estadual"
    assert docs["1200013"]["disasters"]["history"]["all_event_count"] == 7
    assert docs["2605459"]["land_cover"]["history"] == []
    assert docs["2605459"]["land_cover"]["change"] is None
    capacity = docs["5101837"]["municipal_capacity"]
    assert capacity["state"] == "not_in_source" and set(capacity["indicators"].values()) == {"not_in_source"}
    assert docs["4202404"]["municipal_capacity"]["indicators"]["flood_early_warning"] == "not_reported"
    assert docs["2903953"]["transfers"]["legacy"]["latest"]["number"] == "723958"


def test_summary_sentences(exported):
    docs = exported[2]
    assert docs["4202404"]["summary"]["thirty_second_text"] == (
        "Desde 1991, foram encontrados 32 registros relacionados à chuva em Blumenau. Enxurradas é o tipo mais "
        "frequente na série consultada. O registro mais recente é de 2025. No território, a área classificada "
        "como urbanizada passou de 0.01 km² em 1985 para 1.57 km² em 2025.")
    assert docs["1200013"]["summary"]["thirty_second_text"] == (
        "Nenhum registro foi encontrado nesta release do Atlas/S2ID.")
    assert "1 registro relacionados" in docs["2605459"]["summary"]["thirty_second_text"]
    assert "urbanizada" not in docs["2605459"]["summary"]["thirty_second_text"]


def test_annual_months_and_types_reconcile(exported):
    doc = exported[2]["4202404"]
    annual = doc["disasters"]["history"]["annual"]
    assert annual["benchmark"]["immediate_region"]["municipality_count"] == 9
    assert [s["atlas_type_id"] for s in annual["series"]] == [None, 1, 2, 7, 8, 13]
    points = annual["series"][0]["points"]
    assert [p["year"] for p in points] == list(range(2004, 2026))
    assert points[-1]["municipal_event_count"] == 1
    assert points[-1]["immediate_region_average_event_count"] == pytest.approx(1 / 9)
    assert doc["disasters"]["months"][0]["event_pct"] == pytest.approx(6 / 32 * 100)
    assert len(doc["disasters"]["months"]) == 12
    types = doc["disasters"]["types"]
    assert sum(t["event_pct"] for t in types) == pytest.approx(100)
    mass = next(t for t in types if t["atlas_type_id"] == 8)
    assert mass["event_count"] == mass["deaths"] == 2 and len(mass["cobrade_codes"]) == 8
    assert [t["atlas_type_id"] for t in types] == [2, 8, 1, 7, 13]
    empty = exported[2]["1200013"]["disasters"]
    assert all(m["event_pct"] is None for m in empty["months"])
    assert all(t["event_pct"] == 0 for t in empty["types"])


def test_benchmarks(exported):
    docs = exported[2]
    region = docs["4202404"]["benchmarks"]["immediate_region"]
    rain = region["metrics"]["rain_related_event_count_10y"]
    assert rain["municipality_value"] == 3 and rain["reference"] == {"reference_date": "2025-12-31", "window_years": 10}
    assert rain["denominator"] == {"included": 9, "missing": 0, "undefined": 0}
    assert rain["mean"] == pytest.approx(8 / 9) and rain["median"] == 1
    assert rain["percentile_strictly_lower_pct"] == pytest.approx(8 / 9 * 100)
    urban = region["metrics"]["urban_area_pct"]
    assert urban["denominator"] == {"included": 8, "missing": 1, "undefined": 0}
    assert urban["percentile_strictly_lower_pct"] == pytest.approx(5 / 8 * 100)
    # The history has no row of 2005, so a 20-year change is undefined for every covered unit.
    change = region["metrics"]["urban_change_20y_pct"]
    assert change["denominator"] == {"included": 0, "missing": 1, "undefined": 8}
    assert change["mean"] is None and change["percentile_strictly_lower_pct"] is None
    uncovered = docs["2605459"]["benchmarks"]["immediate_region"]["metrics"]["urban_area_pct"]
    assert uncovered["municipality_value"] is None and uncovered["reference"]["latest_snapshot_year"] is None


def test_horizons_without_a_reference_row_are_null(exported):
    change = exported[2]["4202404"]["land_cover"]["change"]
    assert change["reference_year_5y"] is None and change["urban_change_20y_pct"] is None
    assert change["first_year"] == 1985 and change["urban_area_change_ha"] == 1.0


def test_index_points_at_the_shard_of_each_unit(spark, exported):
    out, _, _, lines = exported
    index = {r.codigo_ibge: r.shard for r in spark.read.json(f"{out}/index").collect()}
    assert len(index) == 9
    for line in lines:
        assert index[line.codigo_ibge] == f"/data/v1/uf/{line.file}"
        assert line.file == f"{line.uf}.json"


def test_documents_are_stable_and_sorted(spark, exported):
    for line in exported[3]:
        assert list(json.loads(line.document)) == sorted(json.loads(line.document))


def test_small_cap_gives_numbered_parts(spark):
    rows = [("AA", f"{i:07d}", "x" * 100) for i in range(4)]
    encoded = spark.createDataFrame(rows, "uf string, codigo_ibge string, document string")
    one = len('{"municipalities":{"0000000":' + "x" * 100 + '},"schema_version":"v1","uf":"AA"}\n')
    plan = {r.codigo_ibge: r.file for r in profiles.plan_shards(encoded, one).collect()}
    assert plan == {f"{i:07d}": f"AA-{i + 1:03d}.json" for i in range(4)}
    with pytest.raises(Exception, match="item larger than a shard"):
        profiles.plan_shards(encoded, one - 1).collect()


def test_more_than_a_thousand_parts_keep_their_names(spark, tmp_path):
    """Numbers of four digits are not cut, so no two shards share a file, and each fits its size."""
    rows = [("AA", f"{i:07d}", json.dumps({"municipality": {"codigo_ibge": f"{i:07d}", "uf": "AA"}})) for i in range(1010)]
    encoded = spark.createDataFrame(rows, "uf string, codigo_ibge string, document string")
    size = 150
    plan = profiles.plan_shards(encoded, size)
    placed = encoded.join(plan.select("codigo_ibge", "file"), "codigo_ibge")
    bodies = shard_documents(placed, "uf", "codigo_ibge", "document", "file", "v1")
    write_named_texts(bodies, str(tmp_path / "uf"), "file", "body")
    files = sorted((tmp_path / "uf").glob("*.json"))
    assert len(files) == 1010 and {"AA-001.json", "AA-1000.json", "AA-1010.json"} <= {f.name for f in files}
    assert max(f.stat().st_size for f in files) <= size
    held = read_shard_documents(spark, str(tmp_path / "uf"), "struct<codigo_ibge:string,uf:string>").collect()
    assert {r.codigo_ibge: r.file for r in held} == {r.codigo_ibge: r.file for r in plan.collect()}
    assert all(r.municipality.codigo_ibge == r.codigo_ibge for r in held)


def test_a_failed_check_leaves_the_site_alone(spark, tmp_path):
    out = tmp_path / "site"
    export_profiles(gold.gold_tables(spark), gold.legacy(spark), str(out), expected_units=9)
    before = {p: p.stat().st_mtime_ns for p in out.rglob("*.json")}
    tables = gold.gold_tables(spark)
    with pytest.raises(Exception, match="change row missing"):
        export_profiles({**tables, "change": tables["change"].filter("codigo_ibge <> '4202404'")}, gold.legacy(spark), str(out))
    assert {p: p.stat().st_mtime_ns for p in out.rglob("*.json")} == before


def test_broken_inputs_are_refused(spark, tmp_path):
    tables = gold.gold_tables(spark)
    twice = {**tables, "dim": tables["dim"].unionByName(tables["dim"].limit(1))}
    with pytest.raises(ContractError, match="repeated code"):
        export_profiles(twice, gold.legacy(spark), str(tmp_path / "a"))
    no_change = {**tables, "change": tables["change"].filter("codigo_ibge <> '4202404'")}
    with pytest.raises(Exception, match="change row missing for 4202404"):
        profiles.land_cover_section(no_change["dim"], no_change["history"], no_change["change"]).collect()
    no_survey = {**tables, "survey": tables["survey"].filter("codigo_ibge <> '4202404'")}
    with pytest.raises(Exception, match="survey row missing for 4202404"):
        profiles.unit_profiles(**no_survey, legacy=gold.legacy(spark)).collect()
    wrong_type = {**tables, "fact": tables["fact"].withColumn("atlas_type_id", F.lit(1).cast("short"))}
    with pytest.raises(Exception, match="outside the type catalogue"):
        profiles.flagged_events(wrong_type["fact"]).collect()


def test_contract_rules_name_what_is_broken(spark):
    tables = gold.gold_tables(spark)
    fewer = {**tables, "snapshot": tables["snapshot"].withColumn(
        "rain_related_event_count", F.when(F.col("codigo_ibge") == "4202404", 31).otherwise(
            F.col("rain_related_event_count")))}
    assembled = profiles.unit_profiles(**fewer, legacy=gold.legacy(spark))
    assert {(r.codigo_ibge, r.rule) for r in profiles.document_violations(assembled).collect()} == {
        ("4202404", "type_counts")}


def test_leap_day_boundary_is_strict(spark):
    from panelspark.operators.events import history_snapshot

    fact = spark.createDataFrame(
        [("4202404", "2016-02-28", True), ("4202404", "2016-02-29", True), ("4202404", "2026-02-28", False)],
        "codigo_ibge string, day string, flag boolean").withColumn("day", F.to_date("day"))
    dim = spark.createDataFrame([("4202404",), ("1200013",)], "codigo_ibge string")
    rows = {r.codigo_ibge: r for r in history_snapshot(dim, fact, "codigo_ibge", "day", "flag", "rain", windows=(10,)).collect()}
    assert str(rows["4202404"].reference_date) == "2026-02-28"
    assert rows["4202404"].rain_event_count_10y == 1 and rows["4202404"].rain_event_count == 2
    assert rows["1200013"].event_count == 0 and rows["1200013"].first_event_date is None


def test_repeated_months_are_refused(spark):
    tables = gold.gold_tables(spark)
    twice = tables["months"].unionByName(tables["months"].filter("month = 8"))
    with pytest.raises(Exception, match="month profile repeated for 4202404"):
        profiles.months_section(tables["dim"], twice, tables["snapshot"]).collect()


def test_the_encoded_document_is_judged(spark):
    from pyspark.sql.types import StructType

    documents = profiles.unit_profiles(**gold.gold_tables(spark), legacy=gold.legacy(spark))
    schema = StructType([documents.schema[s] for s in profiles.SECTIONS])
    text, code = F.col("document"), F.col("codigo_ibge")
    swap = lambda old, new: F.replace(text, F.lit(old), F.lit(new))
    encoded = profiles.encode(documents).select("codigo_ibge", F.when(code == "4202404", F.lit('{"census":'))
        .when(code == "3550308", F.lit(None)).when(code == "3304557", swap('"transfers":', '"transfers_":'))
        .when(code == "5300108", swap('"schema_version":"v1"', '"schema_version":null')).otherwise(text).alias("document"))
    found = {(r.codigo_ibge, r.rule) for r in profiles.encoded_violations(encoded, schema).collect()}
    assert found == {("4202404", "readable"), ("3550308", "readable"), ("3304557", "section_transfers"),
                     ("3304557", "transfers_state"), ("5300108", "section_schema_version"), ("5300108", "schema_version")}
    assert profiles.encoded_violations(encoded.limit(0), schema).count() == 0


def test_each_input_of_the_profile_is_exchanged_by_unit_once(spark):
    """The sections meet already partitioned by unit: no exchange lies above a join on the unit."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = profiles.unit_profiles(**gold.gold_tables(spark), legacy=gold.legacy(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    top = [line for line in plan.splitlines() if "SortMergeJoin [codigo_ibge" in line or "Exchange hashpartitioning" in line]
    first_exchange = next(i for i, line in enumerate(top) if "Exchange" in line)
    assert first_exchange >= 8, top[:12]
