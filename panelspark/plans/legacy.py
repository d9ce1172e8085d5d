"""The transitional municipal listing: census, event history and transfers per unit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.numbers import (complement_pct, lenient_int, numeric_text, serial_to_date)
from panelspark.functions.text import full_match, split_label
from panelspark.operators.events import event_rollup
from panelspark.operators.release import parity_report, parity_summary
from panelspark.presets import events as ev, legacy as lg
from panelspark.sinks.writers import write_csv, write_json_lines
from panelspark.sources.readers import representative_sample


def census_units(rows: DataFrame) -> DataFrame:
    """Code, name, state and the sewer indicator; text that is no number means not published.

    ``rows`` has the columns D1C, D1N and V; the listing's title row is left out by its code.
    """
    name, uf = split_label(F.col("D1N"))
    connected = numeric_text(F.col("V"))
    return rows.filter(full_match(F.col("D1C"), "[0-9]+")).select(
        F.col("D1C").alias("code"), name.alias("name"), uf.alias("uf"),
        F.struct(F.round(connected, 2).alias("connectedSewerPct"),
                 complement_pct(connected).alias("outsideSelectedSewerPct"),
                 F.lit(lg.CENSUS_YEAR).alias("year")).alias("census"))


def workbook_history(sheet: DataFrame) -> DataFrame:
    """Rain-related history per unit out of the landed event sheet (all text, serial dates)."""
    labels = F.create_map(*[F.lit(x) for item in lg.TYPE_LABELS.items() for x in item])
    count = lambda c: lenient_int(F.col(c))
    rows = sheet.select(
        F.trim(F.coalesce("Cod_IBGE_Mun", F.lit(""))).alias("code"),
        F.try_element_at(labels, F.col("tipologia")).alias("type"),
        F.year(serial_to_date(F.col("Data_Evento"))).alias("year"), "Status",
        count("DH_MORTOS").alias("deaths"), count("DH_FERIDOS").alias("injured"),
        (count("DH_DESABRIGADOS") + count("DH_DESALOJADOS")).alias("displaced"),
        count("DH_DESAPARECIDOS").alias("missing"))
    kept = rows.filter(F.col("type").isNotNull() & full_match(F.col("code"), "[0-9]{7}"))
    return event_rollup(kept, "code", "year", "type",
                        F.coalesce(F.col("Status") == ev.RECOGNIZED_STATUS, F.lit(False)),
                        {c: F.col(c) for c in ("deaths", "injured", "displaced", "missing")})


def _as_map(entries: Column) -> Column:
    """Counter array to a map in the same order (JSON keeps it)."""
    pairs = F.transform(F.coalesce(entries, F.array().cast("array<struct<label:string,n:bigint>>")),
                        lambda e: F.struct(e["label"].cast("string"), e["n"]))
    return F.map_from_entries(pairs)


def legacy_units(census: DataFrame, history: DataFrame, transfers: DataFrame) -> DataFrame:
    """One row per census unit, ordered by state and folded name; history or transfers may be null."""
    typed = history.withColumns({
        c: F.transform(F.col(c), lambda e: F.struct(e["label"].cast("string").alias("label"), e["n"].alias("n")))
        for c in ("types", "years")})
    events = typed.select("code", F.struct(
        "records", "recognized", F.col("first_year").alias("firstYear"), F.col("last_year").alias("lastYear"),
        _as_map(F.col("types")).alias("types"), _as_map(F.col("years")).alias("years"),
        "deaths", "injured", "displaced", "missing").alias("history"))
    grants = transfers.select("code", F.struct(
        "agreements", F.col("first_year").alias("firstYear"), F.col("last_year").alias("lastYear"),
        "actions", "latest", "attribution").alias("transfers"))
    return (census.join(events, "code", "left").join(grants, "code", "left")
            .orderBy("uf", fold_order("name"), "code"))


def fold_order(name: str) -> Column:
    """Sort key for names that ignores case."""
    return F.lower(F.col(name))


def canonical_metrics(dim: DataFrame, fact: DataFrame) -> DataFrame:
    """The listing's history metrics recomputed from the published event fact, zero for no event."""
    labels = F.create_map(*[F.lit(x) for k, v in lg.TYPE_LABELS.items() for x in (int(k), v)])
    rain = fact.filter("is_rain_related").withColumn(
        "__type", F.try_element_at(labels, F.col("atlas_type_id").cast("int")))
    rolled = event_rollup(rain, "codigo_ibge", "event_year", "__type", F.col("is_federally_recognized"), {
        "deaths": F.col("deaths"), "injured": F.col("injured"),
        "displaced": F.col("homeless") + F.col("displaced"), "missing": F.col("missing")})
    return _metrics(dim.select(F.col("codigo_ibge").alias("code")).join(
        rolled.withColumnRenamed("codigo_ibge", "code"), "code", "left"))


def listing_metrics(census: DataFrame, history: DataFrame) -> DataFrame:
    return _metrics(census.select("code").join(history, "code", "left"))


COUNTS = ("records", "recognized", "deaths", "injured", "displaced", "missing")
METRICS = (*COUNTS, "first_year", "last_year", "types", "years")


def _metrics(rows: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.array_join(F.transform(F.col(c), lambda e: F.concat_ws(
        ":", e["label"].cast("string"), e["n"].cast("string"))), ","), F.lit(""))
    return rows.select(
        "code", *[F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c) for c in COUNTS],
        *[F.col(c).cast("int").alias(c) for c in ("first_year", "last_year")],
        text("types").alias("types"), text("years").alias("years"))


def listing_parity(listing: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Differences per unit and metric, and the one-row summary."""
    return (parity_report(listing, canonical, "code", METRICS),
            parity_summary(listing, canonical, "code", METRICS))


def write_samples(listing: DataFrame, survey: DataFrame, folder: str,
                  codes: Sequence[str] = lg.SAMPLE_CODES, states: int = lg.STATES) -> None:
    """Small versionable extracts of a fixed list of units; maps and lists as JSON text in CSV."""
    root = folder.rstrip("/")
    sample = representative_sample(listing, "code", codes, "uf", states, ["uf", "name"])
    identity = [F.col("code").alias("codigo_ibge"), F.col("name").alias("municipio"), "uf"]
    write_json_lines(sample, f"{root}/municipios")
    write_csv(sample.select(
        *identity, F.col("census.year").alias("ano"), F.col("census.connectedSewerPct").alias("rede_geral_pct"),
        F.col("census.outsideSelectedSewerPct").alias("fora_formas_selecionadas_pct")), f"{root}/censo")
    h = "history."
    write_csv(sample.filter("history is not null").select(
        *identity, F.col(h + "records").alias("registros"), F.col(h + "recognized").alias("reconhecidos"),
        F.col(h + "firstYear").alias("primeiro_ano"), F.col(h + "lastYear").alias("ultimo_ano"),
        F.col(h + "deaths").alias("mortos"), F.col(h + "injured").alias("feridos"),
        F.col(h + "displaced").alias("desabrigados_desalojados"), F.col(h + "missing").alias("desaparecidos"),
        F.col(h + "types").alias("tipologias_json"), F.col(h + "years").alias("anos_json")),
        f"{root}/atlas", json_columns=["tipologias_json", "anos_json"])
    t = "transfers."
    write_csv(sample.filter("transfers is not null").select(
        *identity, F.col(t + "agreements").alias("convenios"), F.col(t + "firstYear").alias("primeiro_ano"),
        F.col(t + "lastYear").alias("ultimo_ano"), F.col(t + "actions").alias("acoes_json"),
        F.col(t + "latest.number").alias("numero_mais_recente"), F.col(t + "latest.year").alias("ano_mais_recente"),
        F.col(t + "latest.status").alias("situacao_mais_recente"), F.col(t + "latest.object").alias("objeto_mais_recente"),
        F.col(t + "latest.globalValue").alias("valor_global_mais_recente"),
        F.col(t + "attribution").alias("criterio_atribuicao")), f"{root}/transferegov", json_columns=["acoes_json"])
    kept = [c for c in survey.columns if c != "ingested_at"]
    write_csv(representative_sample(survey.select(*kept), "codigo_ibge", codes, "sigla_uf", states,
                                    ["codigo_ibge"]), f"{root}/munic")
