import json

import pytest
from pyspark.sql import Row, functions as F

from panelspark.plans import legacy
from panelspark.sources.contracts import ContractError

COLUMNS = ("Cod_IBGE_Mun", "tipologia", "Data_Evento", "Status", "DH_MORTOS", "DH_FERIDOS", "DH_DESABRIGADOS",
           "DH_DESALOJADOS", "DH_DESAPARECIDOS")


def sheet(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS))


@pytest.fixture()
def parts(spark):
    census = legacy.census_units(spark.createDataFrame(
        [("Município (Código)", "Município", "Valor"), ("4202404", "Blumenau - SC", "67.62"),
         ("4200101", "abelardo - SC", "..."), ("1200013", "Acrelândia - AC", "100")], "D1C string, D1N string, V string"))
    history = legacy.workbook_history(sheet(spark, [
        ("4202404", "2", "45000.5", "Reconhecido", "1", "2,5", "3", "4", ""), ("4202404", "2", "bad", "x", None, "1", "", "", "1"),
        ("4202404", "13", "44000", "x", "0", "0", "0", "0", "0"), ("4202404", "99", "44000", "x", "9", "9", "9", "9", "9"),
        ("42", "2", "44000", "x", "9", "9", "9", "9", "9"), ("1200013", "1", "44000", None, "0", "0", "0", "0", "0")]))
    transfers = spark.createDataFrame(
        [("4200101", 1, 2001, 2002, ["8172"], Row("n", 2002, "ok", "obra", 5.0), "criterio")],
        "code string, agreements long, first_year int, last_year int, actions array<string>, "
        "latest struct<number: string, year: int, status: string, object: string, globalValue: double>, attribution string")
    return census, history, transfers


def test_listing_rows(spark, parts):
    rows = legacy.legacy_units(*parts).collect()
    assert [r.code for r in rows] == ["1200013", "4200101", "4202404"]
    history = rows[2].history
    assert (history.records, history.recognized, history.firstYear, history.lastYear) == (3, 1, 2020, 2023)
    assert (history.deaths, history.injured, history.displaced, history.missing) == (1, 3, 7, 1)
    encoded = legacy.legacy_units(*parts).filter("code = '4202404'").select(F.to_json("history.types").alias("j")).first().j
    assert encoded == '{"Enxurradas":2,"Chuvas intensas":1}'
    assert history.years == {"2020": 1, "2023": 1}
    assert rows[2].census.outsideSelectedSewerPct == 32.38 and rows[1].census.connectedSewerPct is None
    assert rows[1].history is None and rows[1].transfers.latest.number == "n" and rows[2].transfers is None


def test_parity_with_the_published_fact(spark, parts):
    census, history, _ = parts
    dim = spark.createDataFrame([("4202404",), ("1200013",), ("9999999",)], "codigo_ibge string")
    fact = spark.createDataFrame(
        [("4202404", True, 2, 2023, True, 1, 2, 3, 4, 0), ("4202404", True, 2, None, False, 0, 1, 0, 0, 1),
         ("4202404", True, 13, 2020, False, 0, 0, 0, 0, 0), ("4202404", False, 5, 2020, False, 9, 9, 9, 9, 9),
         ("1200013", True, 8, 2020, False, 0, 0, 0, 0, 0)],
        "codigo_ibge string, is_rain_related boolean, atlas_type_id short, event_year int, is_federally_recognized boolean, "
        "deaths long, injured long, homeless long, displaced long, missing long")
    report, summary = legacy.listing_parity(legacy.listing_metrics(census, history), legacy.canonical_metrics(dim, fact))
    assert [(r.code, r.metric, r.old_value, r.new_value) for r in report.collect()] == [
        ("1200013", "types", "Alagamentos:1", "Movimento de massa:1")]
    counts = summary.first()
    assert (counts.common_keys, counts.old_only, counts.new_only, counts.difference_count) == (2, 1, 1, 1)


def test_samples_cover_the_listed_units(spark, parts, tmp_path):
    listing = legacy.legacy_units(*parts)
    survey = spark.createDataFrame([("4202404", "SC", "declared_yes", "t"), ("1200013", "AC", "refused", "t")],
                                   "codigo_ibge string, sigla_uf string, flood_risk_mapping_status string, ingested_at string")
    legacy.write_samples(listing, survey, str(tmp_path), ("4202404", "1200013"), 2)
    read = lambda name: spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / name)).collect()
    history = {r.codigo_ibge: r for r in read("atlas")}
    assert json.loads(history["4202404"].tipologias_json) == {"Enxurradas": 2, "Chuvas intensas": 1}
    assert len(read("censo")) == 2 and len(read("transferegov")) == 0 and "ingested_at" not in read("munic")[0].asDict()
    with pytest.raises(ContractError, match="keys not found"):
        legacy.write_samples(listing, survey, str(tmp_path / "b"), ("4202404", "0000000"), 2)
