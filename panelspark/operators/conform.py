"""Units, events and survey answers brought to their contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.numbers import lenient, parse_day, strict_count, strict_money
from panelspark.functions.states import answer_state, combine_states, override_state
from panelspark.functions.text import blank_to_null, full_match, normalize_exact, normalize_name
from panelspark.operators.keys import left_with_match
from panelspark.presets import events as ev, survey as sv, units as un
from panelspark.sources.contracts import pick_case_insensitive, require, with_lineage


def special_type(code: Column, overrides: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for item in overrides.items() for x in item]
    if not pairs:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(default))


def conform_units(raw: DataFrame, overrides: dict[str, str] = un.SPECIAL_TYPES,
                  exact_names: bool = True, **lineage) -> DataFrame:
    """Flatten the nested territory rows: text codes, normalised name, required hierarchy.

    The two legacy levels may be absent (null); every other level must be present.
    """
    immediate = F.col("`regiao-imediata`")
    intermediate = immediate["regiao-intermediaria"]
    state = intermediate["UF"]
    region = state["regiao"]
    micro, meso = F.col("microrregiao"), F.col("microrregiao")["mesorregiao"]

    def need(level, name, path):
        return require(level[name], f"{path}.{name}").cast("string")

    code, name = F.col("id").cast("string"), F.col("nome").cast("string")
    flat = raw.select(
        require(code, "id").alias("codigo_ibge"),
        require(name, "nome").alias("municipio"),
        (normalize_exact(name) if exact_names else normalize_name(name)).alias("municipio_normalized"),
        need(state, "nome", "UF").alias("uf"),
        need(state, "sigla", "UF").alias("sigla_uf"),
        need(state, "id", "UF").alias("codigo_uf_ibge"),
        need(region, "nome", "regiao").alias("regiao"),
        need(region, "id", "regiao").alias("codigo_regiao"),
        need(immediate, "nome", "regiao-imediata").alias("regiao_imediata"),
        need(immediate, "id", "regiao-imediata").alias("codigo_regiao_imediata"),
        need(intermediate, "nome", "regiao-intermediaria").alias("regiao_intermediaria"),
        need(intermediate, "id", "regiao-intermediaria").alias("codigo_regiao_intermediaria"),
        meso["nome"].cast("string").alias("mesorregiao"),
        meso["id"].cast("string").alias("codigo_mesorregiao"),
        micro["nome"].cast("string").alias("microrregiao"),
        micro["id"].cast("string").alias("codigo_microrregiao"),
        special_type(code, overrides, un.DEFAULT_TYPE).alias("tipo_unidade_territorial"),
    )
    return with_lineage(flat, **lineage)


def unit_dimension(silver: DataFrame) -> DataFrame:
    """The published dimension: the conformed units without the legacy levels."""
    return silver.drop(*un.LEGACY_LEVELS)


def code_levels(code: Column, width: int = 5) -> dict[str, Column]:
    """Zero-padded code and its category, group and subgroup prefixes."""
    padded = F.lpad(code.cast("int").cast("string"), width, "0")
    return {"code": padded, "category": F.substring(padded, 1, 1),
            "group": F.substring(padded, 1, 2), "subgroup": F.substring(padded, 1, 3)}


def event_types(sheet: DataFrame, **lineage) -> DataFrame:
    """The event type dimension with its prefix levels and classification flags."""
    level = code_levels(F.col("Cobrade").cast("double"))
    return with_lineage(sheet.filter(F.col("Cobrade").isNotNull()).select(
        level["code"].alias("cobrade_code"),
        F.col("Desastre").cast("string").alias("disaster_name"),
        F.col("`Atlas - Descrição Tipologia`").cast("string").alias("atlas_type_name"),
        F.col("`Atlas N. Tipologia`").cast("double").cast("smallint").alias("atlas_type_id"),
        F.col("`Grupo de desastres`").cast("string").alias("atlas_group_name"),
        level["category"].alias("cobrade_category_code"),
        level["group"].alias("cobrade_group_code"),
        level["subgroup"].alias("cobrade_subgroup_code"),
        (level["group"] == ev.HYDROLOGICAL_PREFIX).alias("is_hydrological"),
        (level["group"] == ev.GEOLOGICAL_PREFIX).alias("is_geological"),
        level["code"].isin(*ev.RAIN_CODES).alias("is_rain_related"),
        F.lit(ev.CLASSIFICATION_VERSION).alias("classification_version"),
    ), **lineage)


def correction_factors(sheet: DataFrame, factor_column: str, **lineage) -> DataFrame:
    """Yearly monetary correction factors."""
    return with_lineage(sheet.filter(F.col("`Ano Ref`").isNotNull()).select(
        F.col("`Ano Ref`").cast("double").cast("smallint").alias("reference_year"),
        lenient(F.col("`igp-di (dezembro)`"), "double").alias("igp_di_december_index"),
        F.col(f"`{factor_column}`").cast("double").alias("correction_factor"),
        F.lit(ev.CORRECTION_INDEX).alias("correction_index")), **lineage)


def ingest_events(raw: DataFrame, dim: DataFrame, reference_year: int,
                  row_number: str = "source_row_number", **lineage) -> DataFrame:
    """Raw event rows (all text) to SILVER: strict casts, flags, match flag, lineage.

    No row is dropped: anomalies of the source stay visible as flags.
    """
    readers = {
        "text": lambda c: c, "blank": blank_to_null, "date": parse_day,
        "typology": lambda c: F.trim(c).cast("double").cast("smallint"),
        "count": strict_count, "money": strict_money,
    }
    typed = raw.select(*[readers[kind](F.col(f"`{source}`")).alias(target)
                         for source, target, kind in ev.FIELDS], row_number)
    code, key = F.col("cobrade_code"), F.col("source_event_id")
    flagged = typed.withColumns({
        "event_year": F.year("event_date").cast("smallint"),
        "event_month": F.month("event_date").cast("tinyint"),
        "is_federally_recognized": F.col("status_source") == ev.RECOGNIZED_STATUS,
        "reported_affected_total": F.col("direct_human_damage_total") + F.col("other_affected"),
        "is_rain_related": code.isin(*ev.RAIN_CODES),
        "is_hydrological": F.substring(code, 1, 2) == ev.HYDROLOGICAL_PREFIX,
        "is_geological": F.substring(code, 1, 2) == ev.GEOLOGICAL_PREFIX,
        "classification_version": F.lit(ev.CLASSIFICATION_VERSION),
        "is_protocol_format_valid": full_match(key, ev.PROTOCOL_PATTERN),
        "is_protocol_ibge_consistent": F.split_part(key, F.lit("-"), F.lit(3)) == F.col("codigo_ibge"),
        "is_protocol_cobrade_consistent": F.split_part(key, F.lit("-"), F.lit(4)) == code,
        "is_event_after_registration": F.col("event_date") > F.col("registration_date"),
        "monetary_values_are_corrected": F.lit(True),
        "monetary_correction_index": F.lit(ev.CORRECTION_INDEX),
        "monetary_reference_year": F.lit(reference_year).cast("smallint"),
        "source_corrected_material_damage_total_brl": F.col("material_damage_total_brl"),
    })
    matched = left_with_match(flagged, dim, "codigo_ibge", "codigo_ibge",
                              "is_dim_municipality_match")
    return with_lineage(matched, **lineage)


def event_fact(silver: DataFrame) -> DataFrame:
    return silver.select(F.col("source_event_id").alias("disaster_event_id"),
                         *[c for c in silver.columns if c != "source_row_number"])


def workbook_comparators() -> dict[str, tuple[Column, Column]]:
    """How each event field of the text source (l) is compared with its workbook copy (r)."""
    from panelspark.functions.numbers import serial_to_date
    from panelspark.functions.text import clean_workbook_text

    environment = {"DA_Polui/cont da água", "DA_Polui/cont do ar", "DA_Polui/cont do solo",
                   "DA_Dimi/exauri hídrico", "DA_Incêndi parques/APA's/APP's"}
    pairs = {}
    for source, _, kind in ev.FIELDS:
        a, b = F.col(f"l.`{source}`"), F.col(f"r.`{source}`")
        if kind == "date":
            pair = parse_day(a), serial_to_date(b)
        elif source in ("Cod_Cobrade", "Cod_IBGE_Mun"):
            pair = F.trim(a), b.cast("double").cast("bigint").cast("string")
        elif kind == "count":
            pair = lenient(a, "bigint"), F.round(b.try_cast("double"), 0).cast("bigint")
        elif kind == "money":
            pair = lenient(a, "decimal(38,2)"), F.round(b.try_cast("double"), 2).cast("decimal(38,2)")
        elif kind == "typology" or source in environment:
            pair = lenient(a, "double"), b.try_cast("double")
        else:
            pair = F.coalesce(a, F.lit("")), F.coalesce(clean_workbook_text(b), F.lit(""))
        pairs[source] = pair
    return pairs


def survey_silver(sheet: DataFrame, reference_year: int = sv.REFERENCE_YEAR, **lineage) -> DataFrame:
    """Survey answers as states, one combined planning state and the 'unknown' override."""
    wanted = {**sv.IDENTITY_COLUMNS, **sv.PLANNING_COLUMNS, **sv.DIRECT_COLUMNS,
              "__unknown": sv.UNKNOWN_COLUMN}
    rows = pick_case_insensitive(sheet, wanted)
    answers = [*sv.PLANNING_COLUMNS, *sv.DIRECT_COLUMNS, "__unknown"]
    states = rows.withColumns({name: answer_state(F.col(name)) for name in answers})
    body = override_state(F.col(sv.OVERRIDDEN), F.col("__unknown"))
    planning = F.array(*[F.col(name) for name in sv.PLANNING_COLUMNS])

    def status(name: str) -> Column:
        bare = name.removesuffix("_status")
        if bare == sv.COMBINED:
            return combine_states(planning)
        return body if bare == sv.OVERRIDDEN else F.col(bare)

    return with_lineage(states.select(
        *sv.IDENTITY_COLUMNS, *[status(name).alias(name) for name in sv.STATUS_COLUMNS],
        F.lit(reference_year).alias("source_year")), **lineage)


def survey_gold(dim: DataFrame, survey: DataFrame, key: str, status_columns: Sequence[str],
                dim_columns: Sequence[str] = (), carry: Sequence[str] = (),
                reference_year: int | None = None) -> DataFrame:
    """Every current unit; units outside the survey get the state ``not_in_source``."""
    joined = dim.select(key, *dim_columns).join(
        survey.select(key, *status_columns, *carry, F.lit(True).alias("__in")), key, "left")
    out = [key, *dim_columns, F.coalesce(F.col("__in"), F.lit(False)).alias("in_source"),
           *[F.coalesce(F.col(c), F.lit("not_in_source")).alias(c) for c in status_columns]]
    for column in carry:
        value = F.col(column)
        if column == "source_year" and reference_year is not None:
            value = F.coalesce(value, F.lit(reference_year))
        out.append(value.alias(column))
    return joined.select(*out)
