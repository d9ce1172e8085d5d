"""Nine units with every kind of absence, as the published tables (fixed values)."""

from __future__ import annotations

from panelspark.presets import survey as sv

UNITS = [
    ("1200013", "Acrelândia", "acrelandia", "AC", "Norte", "Rio Branco", "municipio"),
    ("2106672", "Milagres do Maranhão", "milagres do maranhao", "MA", "Nordeste", "São Luís", "municipio"),
    ("2605459", "Fernando de Noronha", "fernando de noronha", "PE", "Nordeste", "Recife", "distrito_estadual"),
    ("2903953", "Bom Jesus da Serra", "bom jesus da serra", "BA", "Nordeste", "Vitória da Conquista", "municipio"),
    ("3304557", "Rio de Janeiro", "rio de janeiro", "RJ", "Sudeste", "Rio de Janeiro", "municipio"),
    ("3550308", "São Paulo", "sao paulo", "SP", "Sudeste", "São Paulo", "municipio"),
    ("4202404", "Blumenau", "blumenau", "SC", "Sul", "Blumenau", "municipio"),
    ("5101837", "Boa Esperança do Norte", "boa esperanca do norte", "MT", "Centro-Oeste", "Sorriso", "municipio"),
    ("5300108", "Brasília", "brasilia", "DF", "Centro-Oeste", "Brasília", "distrito_federal"),
]
# code: first, latest, events, flagged, impacts..., flagged in the last ten years
HISTORY = [
    ("1200013", None, None, 7, 0, 0, 0, 0, 0, 0), ("2106672", "2004-03-01", "2004-03-01", 1, 1, 0, 0, 0, 0, 0),
    ("2605459", "2019-04-25", "2019-04-25", 3, 1, 0, 0, 0, 0, 1), ("2903953", None, None, 0, 0, 0, 0, 0, 0, 0),
    ("3304557", "1996-09-01", "2024-01-14", 29, 23, 81, 132, 0, 12662, 1),
    ("3550308", "1993-02-20", "2020-02-20", 68, 64, 53, 159, 0, 28305, 1),
    ("4202404", "1991-10-15", "2025-12-27", 35, 32, 34, 2524, 7289, 148456, 3),
    ("5101837", None, None, 0, 0, 0, 0, 0, 0, 0), ("5300108", "2021-01-01", "2024-02-01", 17, 2, 0, 0, 0, 80, 2),
]
TYPES = [
    ("2106672", "12100", "2004-03-01", "2004-03-01", 1, 0, 0, 0, 0, 0),
    ("2605459", "13214", "2019-04-25", "2019-04-25", 1, 0, 0, 0, 0, 0),
    ("3304557", "13214", "1996-09-01", "2024-01-14", 23, 81, 132, 0, 12662, 18),
    ("3550308", "12300", "1993-02-20", "2020-02-20", 64, 53, 159, 0, 28305, 22),
    ("4202404", "12200", "1991-10-15", "2025-12-27", 30, 32, 2524, 7289, 148456, 6),
    ("4202404", "11311", "2020-01-01", "2020-01-01", 1, 1, 0, 0, 0, 0),
    ("4202404", "11312", "2021-01-01", "2021-01-01", 1, 1, 0, 0, 0, 0),
    ("5300108", "13214", "2021-01-01", "2024-02-01", 2, 0, 0, 0, 80, 0),
]
MONTHS = [("2106672", 3, 1, 1), ("2605459", 4, 1, 1), ("3304557", 1, 29, 23), ("3550308", 2, 68, 64),
          ("4202404", 1, 6, 6), ("4202404", 8, 2, 2), ("5300108", 1, 17, 2)]
FACT = [
    ("2106672", "12100", 0, 7, 2004), ("2605459", "13214", 0, 13, 2019), ("3304557", "13214", 18, 13, 2024),
    ("3550308", "12300", 22, 1, 2020), ("4202404", "12200", 6, 2, 2025), ("4202404", "11311", 0, 8, 2020),
    ("4202404", "11312", 0, 8, 2021), ("5300108", "13214", 0, 13, 2024),
]
# code: urban then native hectares in 1985 and 2025, water, wetland (of 1000 mapped)
COVER = [("1200013", 1, 10, 900, 800, 10, 0), ("2106672", 1, 10, 900, 800, 10, 0),
         ("2903953", 1, 10, 900, 800, 10, 0), ("3304557", 1, 490, 300, 310, 20, 5),
         ("3550308", 1, 590, 300, 270, 58, 11), ("4202404", 1, 157, 700, 689, 55, 0),
         ("5101837", 1, 10, 900, 800, 10, 0), ("5300108", 1, 125, 500, 473, 65, 36)]
CENSUS = {"1200013": 0.85, "2106672": None, "2605459": 79.22, "2903953": 0.16, "3304557": 94.9,
          "3550308": 95.23, "4202404": 67.62, "5300108": 86.22}
EDGE_STATES = {  # code: disasters, land cover, census, transfers
    "4202404": ("record", "record", "record", "no_record"),
    "3550308": ("record", "record", "record", "no_record"),
    "3304557": ("record", "record", "record", "no_record"),
    "5300108": ("record", "record", "record", "no_record"),
    "2605459": ("record", "no_coverage", "record", "no_record"),
    "5101837": ("no_record", "record", "not_in_legacy_universe", "not_in_legacy_universe"),
    "1200013": ("no_record", "record", "record", "no_record"),
    "2903953": ("no_record", "record", "record", "record"),
    "2106672": ("record", "record", "not_published", "no_record"),
}
IMPACTS = "deaths double, injured double, homeless double, displaced double"


def gold_tables(spark, reference="2025-12-31"):
    dim = spark.createDataFrame(
        [(*u, "fixture-region") for u in UNITS],
        "codigo_ibge string, municipio string, municipio_normalized string, sigla_uf string, regiao string, "
        "regiao_imediata string, tipo_unidade_territorial string, codigo_regiao_imediata string")
    snapshot = spark.createDataFrame(
        [(h[0], h[1], h[2], h[3], h[4], *map(float, h[5:9]), reference, h[9]) for h in HISTORY],
        f"codigo_ibge string, first_event_date string, latest_event_date string, event_count long, "
        f"rain_related_event_count long, {IMPACTS}, reference_date string, rain_related_event_count_10y long")
    types = spark.createDataFrame(
        [(*t[:5], *map(float, t[5:])) for t in TYPES],
        f"codigo_ibge string, cobrade_code string, first_event_date string, latest_event_date string, "
        f"event_count long, {IMPACTS}, reported_affected_total double")
    months = spark.createDataFrame(
        MONTHS, "codigo_ibge string, month byte, event_count long, rain_related_event_count long")
    fact = spark.createDataFrame(
        [(*f[:2], True, True, *f[2:]) for f in FACT],
        "codigo_ibge string, cobrade_code string, is_federally_recognized boolean, is_rain_related boolean, "
        "missing long, atlas_type_id short, event_year short")
    history, change = [], []
    for code, u0, u1, n0, n1, water, wetland in COVER:
        for year, urban, native in ((1985, u0, n0), (2025, u1, n1)):
            history.append((code, year, 1000.0, float(urban), urban / 10, float(native), native / 10, 0.0, 0.0,
                            float(water), water / 10, float(wetland), wetland / 10))
        change.append((code, 1985, 2025, 2020, 2015, 2005, *[1.0] * 22))
    areas = ", ".join(f"{g}_area_ha double, {g}_area_pct double" for g in (
        "urban", "native_vegetation", "agriculture_livestock", "water", "wetland"))
    history = spark.createDataFrame(history, f"codigo_ibge string, year int, mapped_area_ha double, {areas}")
    names = ["urban_area_first_year_ha", "urban_area_latest_year_ha", "urban_area_change_ha", "urban_area_change_pct"]
    names += [f"urban_change_{h}y_{u}" for h in (5, 10, 20) for u in ("ha", "pct")]
    names += ["native_vegetation_first_year_ha", "native_vegetation_latest_year_ha",
              "native_vegetation_change_ha", "native_vegetation_change_pct"]
    names += [f"native_vegetation_change_{h}y_{u}" for h in (5, 10, 20) for u in ("ha", "pct")]
    names += ["water_area_change_10y_ha", "wetland_area_change_10y_ha"]
    change = spark.createDataFrame(change, "codigo_ibge string, first_year int, latest_year int, " + ", ".join(
        f"reference_year_{h}y int" for h in (5, 10, 20)) + ", " + ", ".join(f"{n} double" for n in names))
    mixed = ["declared_yes", "declared_yes", "declared_yes", "declared_yes", "declared_no", "not_reported",
             "declared_yes", "declared_no", "unknown"]
    answers = []
    for code, *_ in UNITS:
        states = (["not_in_source"] * 9 if code == "5101837" else mixed if code == "4202404" else ["declared_no"] * 9)
        answers.append((code, code != "5101837", *states, 2020))
    survey = spark.createDataFrame(answers, "codigo_ibge string, in_source boolean, " + ", ".join(
        f"{i}_status string" for i in sv.PUBLISHED_INDICATORS) + ", source_year int")
    return {"dim": dim, "snapshot": snapshot, "types": types, "months": months, "fact": fact,
            "history": history, "change": change, "survey": survey}


LEGACY_SCHEMA = (
    "code string, census struct<connectedSewerPct: double, outsideSelectedSewerPct: double, year: int>, "
    "transfers struct<agreements: int, firstYear: int, lastYear: int, actions: array<string>, attribution: string, "
    "latest: struct<number: string, year: int, status: string, object: string, globalValue: double>>")


def legacy(spark):
    rows = []
    for code, pct in CENSUS.items():
        transfers = None
        if code == "2903953":
            transfers = (1, 2009, 2009, ["prevenção/preparação"], "objeto menciona o município",
                         ("723958", 2009, "Prestação de Contas Aprovada", "Construção de cisternas.", 499950.0))
        rows.append((code, (pct, None if pct is None else round(100 - pct, 2), 2022), transfers))
    return spark.createDataFrame(rows, LEGACY_SCHEMA)
