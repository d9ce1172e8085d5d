"""The published unit profile over the driver tables in the nine roles it is assembled from.

Customers are units (nation: immediate region), orders are events of four flagged types and one
other, line items are the land-cover panel of the units that share a supplier's key; the seven
shipping years stand five years apart, so every horizon has its reference year.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from panelspark.functions.numbers import complement_pct
from panelspark.functions.states import SOURCE_STATES
from panelspark.operators import events as op, panel as pl, profiles
from panelspark.presets import events as ev, profiles as pf, survey as sv, units as un
from panelspark.queries.registry import query, table
from panelspark.session import cut_lineage, scratch_path
from panelspark.sinks.writers import write_json_lines

UNIT = profiles.UNIT
# Priority to (type, code); the last one is no flagged type.
ROLES = {"1-URGENT": (1, "12300"), "2-HIGH": (2, "12200"), "3-MEDIUM": (7, "12100"),
         "4-NOT SPECIFIED": (8, "11321"), "5-LOW": (14, "14110")}


def _code(column) -> Column:
    digits = F.col(column).cast("string")
    return F.lpad(digits, F.greatest(F.lit(7), F.length(digits)), F.lit("0"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder, for the many aggregations that read it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dealt(df: DataFrame) -> DataFrame:
    """A few rows per unit, dealt by unit and stored, so that the joins of the sections move none of them again."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartition(parts, UNIT))


def _units(spark, folder) -> DataFrame:
    nation = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("regiao_imediata"),
        F.col("n_regionkey").alias("r_regionkey"),
        F.format_string("%06d", F.col("n_nationkey")).alias("codigo_regiao_imediata"))
    region = table(spark, folder, "region").select("r_regionkey", F.col("r_name").alias("regiao"))
    return (table(spark, folder, "customer").join(nation.join(region, "r_regionkey"), "c_nationkey")
            .select(_code("c_custkey").alias(UNIT), F.col("c_name").alias("municipio"),
                    F.lower("c_name").alias("municipio_normalized"),
                    F.upper(F.substring("regiao_imediata", 1, 2)).alias("sigla_uf"), "regiao", "regiao_imediata",
                    "codigo_regiao_imediata", F.lit(un.DEFAULT_TYPE).alias("tipo_unidade_territorial")))


def _events(spark, folder) -> DataFrame:
    day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    role = F.create_map(*[x for p, (t, c) in ROLES.items() for x in (F.lit(p), F.struct(F.lit(t), F.lit(c)))])
    role = F.element_at(role, F.col("o_orderpriority"))
    return table(spark, folder, "orders").select(
        key.alias("disaster_event_id"), _code("o_custkey").alias(UNIT), day.alias("event_date"),
        F.year(day).alias("event_year"), F.month(day).alias("event_month"),
        role["col1"].alias("atlas_type_id"), role["col2"].alias("cobrade_code"),
        (F.col("o_orderpriority") != "5-LOW").alias("is_rain_related"),
        (F.col("o_orderstatus") == "F").alias("is_federally_recognized"),
        (key % 3).alias("deaths"), (key % 5).alias("injured"),
        F.when(F.col("o_orderstatus") != "O", key % 7).alias("homeless"), (key % 11).alias("displaced"),
        (key % 2).alias("missing"), (key % 13).alias("direct_human_damage_total"),
        (key % 17).alias("reported_affected_total"))


def _survey(spark, folder) -> DataFrame:
    key = F.col("c_custkey")
    inside = key % 50 != 0
    states = F.array(*[F.lit(s) for s in SOURCE_STATES])
    answer = lambda i: F.when(inside, F.get(states, ((key + i) % len(SOURCE_STATES)).cast("int"))).otherwise("not_in_source")
    return table(spark, folder, "customer").select(
        _code("c_custkey").alias(UNIT), inside.alias("in_source"), F.lit(sv.REFERENCE_YEAR).alias("source_year"),
        *[answer(i).alias(f"{name}_status") for i, name in enumerate(sv.PUBLISHED_INDICATORS)])


def _legacy(spark, folder) -> DataFrame:
    key = F.col("c_custkey")
    share = F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 100).cast("double"))
    transfers = F.struct(
        F.lit(1).alias("agreements"), F.lit(2009).alias("firstYear"), F.lit(2009).alias("lastYear"),
        F.array("c_mktsegment").alias("actions"), F.lit("named in the object").alias("attribution"))
    return table(spark, folder, "customer").filter(key % 40 != 0).select(
        _code("c_custkey").alias("code"),
        F.struct(share.alias("connectedSewerPct"), complement_pct(share).alias("outsideSelectedSewerPct"),
                 F.lit(2022).alias("year")).alias("census"),
        F.when(key % 10 == 3, transfers).alias("transfers"))


def roles(spark, folder) -> dict[str, DataFrame]:
    """The nine tables of the profile; the aggregates are made by the library's own operators.

    Events, units, snapshot, history and change have several readers each, so each is made once.
    """
    dim, fact = _dealt(_units(spark, folder)), _stored(_events(spark, folder), "events")
    # Quantities are whole numbers, so areas may be added up before keys become text.
    rows = table(spark, folder, "lineitem").groupBy(
        "l_suppkey", (1985 + 5 * (F.year("l_shipdate") - 1992)).alias("year"), F.col("l_returnflag").alias("class_id"),
        F.col("l_linestatus").alias("biome")).agg(F.sum("l_quantity").alias("area_ha")).withColumn(UNIT, _code("l_suppkey"))
    of = lambda *classes: F.col("class_id").isin(*classes)
    every = _dealt(pl.panel_snapshot(rows, F.lit(True), {
        "urban": of("R"), "native_vegetation": of("A", "N"), "agriculture_livestock": F.col("biome") == "O",
        "water": of("A"), "wetland": of("A") & (F.col("biome") == "F")}, match=None))
    change = _dealt(pl.panel_change(every))
    return {
        "dim": dim, "fact": fact,
        "snapshot": _dealt(op.history_snapshot(dim, fact, UNIT, "event_date", "is_rain_related", "rain_related", ev.IMPACT_COLUMNS)),
        "types": op.type_summary(fact, [UNIT, "cobrade_code"], "event_date", ev.IMPACT_COLUMNS),
        "months": op.month_profile(dim, fact, UNIT, "event_month", "is_rain_related", "rain_related"),
        # A unit that lacks a reference year has no change row and counts as not covered.
        "history": every.join(change.select(UNIT), UNIT, "left_semi"), "change": change,
        "survey": _survey(spark, folder), "legacy": _legacy(spark, folder)}


def _joined(items: Column, *fields) -> Column:
    text = lambda e: F.concat_ws(":", *[f(e).cast("string") for f in fields])
    return F.array_join(F.transform(items, text), "|")


_STATES = "".join(f" WHEN {i} THEN '{s}'" for i, s in enumerate(SOURCE_STATES))
_ANSWERED = " + ".join(f"CAST((k + {i}) % {len(SOURCE_STATES)} = 0 AS INTEGER)" for i in range(len(sv.PUBLISHED_INDICATORS)))
_NAMES = "".join(f" WHEN {i} THEN '{name}'" for i, name, _ in ev.RAIN_CATALOGUE)
DIM = """dim AS (SELECT c_custkey AS k, printf('%07d', c_custkey) AS codigo_ibge, c_name AS municipio, lower(c_name) AS municipio_normalized,
    upper(substr(n_name, 1, 2)) AS uf, r_name AS regiao, n_name AS regiao_imediata, printf('%06d', n_nationkey) AS codigo_regiao_imediata,
    'municipio' AS tipo_unidade_territorial, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

PROFILE_SQL = f"""WITH {DIM},
  fact AS (SELECT o_orderkey AS id, o_custkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS st,
    CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 7 WHEN '4-NOT SPECIFIED' THEN 8 END AS t FROM orders),
  rain AS (SELECT * FROM fact WHERE t IS NOT NULL),
  agg AS (SELECT k, count(*) AS rain, count(*) FILTER (WHERE st = 'F') AS recognized, min(d) AS d0, max(d) AS d1, sum(id % 3) AS deaths,
    coalesce(sum(id % 7) FILTER (WHERE st <> 'O'), 0) AS homeless, sum(id % 17) AS affected,
    count(*) FILTER (WHERE d > (SELECT max(d) FROM fact) - INTERVAL 10 YEAR) AS recent FROM rain GROUP BY k),
  cells AS (SELECT k, t, count(*) AS n FROM rain GROUP BY ALL),
  grid AS (SELECT k, t, coalesce(n, 0) AS n FROM (SELECT k, unnest([1, 2, 7, 8, 13]) AS t FROM dim) LEFT JOIN cells USING (k, t)),
  types AS (SELECT k, string_agg(t || ':' || n, '|' ORDER BY n DESC, t) AS types, arg_max(t, n * 100 - t) AS top FROM grid GROUP BY k),
  mcell AS (SELECT k, month(d) AS m, count(*) AS n, count(t) AS r FROM fact GROUP BY ALL),
  months AS (SELECT k, string_agg(coalesce(n, 0) || ':' || coalesce(r, 0), '|' ORDER BY m) AS months
    FROM (SELECT k, unnest(range(1, 13)) AS m FROM dim) LEFT JOIN mcell USING (k, m) GROUP BY k),
  span AS (SELECT min(year(d)) AS lo, max(year(d)) AS hi FROM rain),
  ycell AS (SELECT k, year(d) AS y, count(*) AS n FROM rain GROUP BY ALL),
  series AS (SELECT k, string_agg(y || ':' || coalesce(n, 0), '|' ORDER BY y) AS annual
    FROM (SELECT k, unnest(range((SELECT lo FROM span), (SELECT hi FROM span) + 1)) AS y FROM dim) LEFT JOIN ycell USING (k, y) GROUP BY k),
  cover AS (SELECT l_suppkey AS k, 1985 + 5 * (year(l_shipdate) - 1992) AS y, sum(l_quantity) AS area,
    coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS urban,
    coalesce(sum(l_quantity) FILTER (WHERE l_returnflag IN ('A', 'N')), 0) AS native FROM lineitem GROUP BY ALL),
  ends AS (SELECT min(y) AS a, max(y) AS b FROM cover),
  chg AS (SELECT k, max(urban) FILTER (WHERE y = b) AS u1, max(urban) FILTER (WHERE y = b - 20) AS u0, max(area) FILTER (WHERE y = b) AS area,
    max(urban) FILTER (WHERE y = a) AS uf0, a, b FROM cover, ends WHERE y IN (a, b, b - 5, b - 10, b - 20) GROUP BY k, a, b
    HAVING bool_or(y = a) AND bool_or(y = b) AND bool_or(y = b - 5) AND bool_or(y = b - 10) AND bool_or(y = b - 20)),
  hist AS (SELECT k, string_agg(y || ':' || CAST(urban AS BIGINT) || ':' || CAST(native AS BIGINT), '|' ORDER BY y) AS history FROM cover JOIN chg USING (k) GROUP BY k),
  base AS (SELECT dim.*, coalesce(rain, 0) AS rain, coalesce(recognized, 0) AS recognized, d0, d1, coalesce(deaths, 0) AS deaths,
    coalesce(homeless, 0) AS homeless, coalesce(affected, 0) AS affected, CAST(coalesce(recent, 0) AS DOUBLE) AS recent,
    chg.k IS NOT NULL AS covered, u0, u1, uf0, a, b, CASE WHEN area > 0 THEN u1 / area * 100.0 END AS share,
    CASE WHEN u0 > 0 AND area > 0 THEN (u1 - u0) / u0 * 100.0 END AS growth FROM dim LEFT JOIN agg USING (k) LEFT JOIN chg USING (k)),
  peers AS (SELECT k, count(*) OVER r AS peer_count, avg(recent) OVER r AS mean_events, median(recent) OVER r AS median_events,
    (rank() OVER (PARTITION BY codigo_regiao_imediata ORDER BY recent) - 1) / CAST(count(*) OVER r AS DOUBLE) * 100.0 AS lower_events_pct,
    count(share) OVER r AS urban_included, count(*) FILTER (WHERE NOT covered) OVER r AS urban_missing,
    CASE WHEN share IS NOT NULL THEN (rank() OVER (PARTITION BY codigo_regiao_imediata ORDER BY share NULLS LAST) - 1) / CAST(count(share) OVER r AS DOUBLE) * 100.0 END AS lower_urban_pct,
    count(*) FILTER (WHERE covered AND growth IS NULL) OVER r AS growth_undefined
    FROM base WINDOW r AS (PARTITION BY codigo_regiao_imediata))
  SELECT codigo_ibge, uf, municipio, CASE WHEN rain = 0 THEN '{pf.NO_RECORD_TEXT}' ELSE
      printf('{pf.FOUND_TEXT.replace("%d", "%s")}', CAST(year(d0) AS VARCHAR), CAST(rain AS VARCHAR), CASE WHEN rain = 1 THEN '{pf.RECORD_WORDS[0]}' ELSE '{pf.RECORD_WORDS[1]}' END, municipio)
      || printf('{pf.TYPE_TEXT}', CASE top {_NAMES} END) || printf('{pf.LATEST_TEXT}', CAST(year(d1) AS VARCHAR))
      || CASE WHEN covered THEN printf('{pf.AREA_TEXT}', uf0 / 100, a, u1 / 100, b) ELSE '' END END AS sentence,
    CASE WHEN rain > 0 THEN 'record' ELSE 'no_record' END || '|' || CASE WHEN covered THEN 'record' ELSE 'no_coverage' END || '|'
      || CASE WHEN k % 50 = 0 THEN 'not_in_source' ELSE 'record' END || '|'
      || CASE WHEN k % 40 = 0 THEN 'not_in_legacy_universe' WHEN c_acctbal >= 0 THEN 'record' ELSE 'not_published' END || '|'
      || CASE WHEN k % 40 = 0 THEN 'not_in_legacy_universe' WHEN k % 10 = 3 THEN 'record' ELSE 'no_record' END AS states,
    CAST(rain AS BIGINT) AS rain_events, CAST(recognized AS BIGINT) AS recognized_events, CAST(d0 AS VARCHAR) AS first_event, CAST(d1 AS VARCHAR) AS latest_event,
    CAST(deaths AS BIGINT) AS deaths, CAST(homeless AS BIGINT) AS homeless, CAST(affected AS BIGINT) AS affected, types, months, annual,
    coalesce(history, '') AS history, u1 - u0 AS urban_change_20y_ha, growth AS urban_change_20y_pct,
    CASE WHEN k % 50 = 0 THEN 0 ELSE {_ANSWERED} END AS declared_yes, CASE WHEN k % 40 <> 0 AND c_acctbal >= 0 THEN floor(c_acctbal / 100) END AS census_pct,
    peer_count, mean_events, median_events, lower_events_pct, urban_included, urban_missing, lower_urban_pct, growth_undefined
  FROM base JOIN types USING (k) JOIN months USING (k) JOIN series USING (k) JOIN peers USING (k) LEFT JOIN hist USING (k)"""


@query("unit_profile", PROFILE_SQL)
def unit_profile(spark, folder):
    """The assembled documents of all units, their ten sections flattened."""
    d, lc = F.col("disasters"), F.col("land_cover")
    region = F.col("benchmarks")["immediate_region"]
    metric = lambda name: region["metrics"][name]
    recent, urban, growth = metric(pf.EVENT_METRIC), metric("urban_area_pct"), metric("urban_change_20y_pct")
    total = F.get(F.filter(d["history"]["annual"]["series"], lambda s: s["atlas_type_id"].isNull()), F.lit(0))
    answers = [F.col("municipal_capacity")["indicators"][i] for i in sv.PUBLISHED_INDICATORS]
    yes = reduce(lambda a, b: a + b, [(a == "declared_yes").cast("int") for a in answers])
    source = F.col("summary")["source_states"]
    return profiles.unit_profiles(**roles(spark, folder)).select(
        UNIT, "uf", F.col("municipality")["municipio"].alias("municipio"),
        F.col("summary")["thirty_second_text"].alias("sentence"),
        F.concat_ws("|", *[source[s] for s in ("atlas", "mapbiomas", "munic", "census", "transferegov")]).alias("states"),
        d["history"]["rain_related_event_count"].alias("rain_events"),
        d["history"]["recognized_event_count"].alias("recognized_events"),
        d["history"]["first_event_date"].alias("first_event"), d["history"]["latest_event_date"].alias("latest_event"),
        *[d["history"]["human_impacts"][c].alias(n) for c, n in (
            ("deaths", "deaths"), ("homeless", "homeless"), ("reported_affected_total", "affected"))],
        _joined(d["types"], lambda t: t["atlas_type_id"], lambda t: t["event_count"]).alias("types"),
        _joined(d["months"], lambda m: m["event_count"], lambda m: m["rain_related_event_count"]).alias("months"),
        _joined(total["points"], lambda p: p["year"], lambda p: p["municipal_event_count"]).alias("annual"),
        _joined(lc["history"], lambda h: h["year"], lambda h: h["urban_area_ha"].cast("bigint"),
                lambda h: h["native_vegetation_area_ha"].cast("bigint")).alias("history"),
        lc["change"]["urban_change_20y_ha"].alias("urban_change_20y_ha"),
        lc["change"]["urban_change_20y_pct"].alias("urban_change_20y_pct"), yes.alias("declared_yes"),
        F.col("census")["connected_sewer_pct"].alias("census_pct"),
        region["municipality_count"].alias("peer_count"), recent["mean"].alias("mean_events"),
        recent["median"].alias("median_events"), recent["percentile_strictly_lower_pct"].alias("lower_events_pct"),
        urban["denominator"]["included"].alias("urban_included"), urban["denominator"]["missing"].alias("urban_missing"),
        urban["percentile_strictly_lower_pct"].alias("lower_urban_pct"),
        growth["denominator"]["undefined"].alias("growth_undefined"))


def _with_faults(documents: DataFrame) -> DataFrame:
    """The documents with a fault planted in every 11th, 13th, ... unit."""
    key = F.col(UNIT).cast("bigint")
    hit = lambda n, changed, column: F.when(key % n == 0, changed).otherwise(column)
    d, mc, lc = F.col("disasters"), F.col("municipal_capacity"), F.col("land_cover")
    b, s = F.col("benchmarks"), F.col("summary")
    included = f"immediate_region.metrics.{pf.EVENT_METRIC}.denominator.included"
    months = hit(13, F.slice(d["months"], 1, 11), d["months"])
    types = hit(17, F.slice(d["types"], 1, 4), d["types"])
    count = d["history"]["rain_related_event_count"]
    return documents.withColumns({
        "schema_version": hit(11, F.lit("v0"), F.col("schema_version")),
        "disasters": d.withField("months", months).withField("types", types).withField(
            "history.rain_related_event_count", hit(37, count + 1, count)),
        "municipal_capacity": hit(19, mc.withField(f"indicators.{sv.PUBLISHED_INDICATORS[0]}", F.lit("bogus")), mc),
        "land_cover": hit(23, lc.withField("state", F.lit("lost")), lc),
        "benchmarks": hit(29, b.withField(included, b["immediate_region"]["metrics"][pf.EVENT_METRIC]["denominator"]["included"] + 1), b),
        "summary": hit(31, s.withField("thirty_second_text", F.lit("")), s)})


@query("document_contract", f"""WITH k AS (SELECT printf('%07d', c_custkey) AS codigo_ibge, c_custkey AS k FROM customer),
  r AS (SELECT codigo_ibge, k, unnest(['schema_version', 'twelve_months', 'five_types', 'survey_states', 'land_cover_state',
      'denominator_{pf.EVENT_METRIC}', 'summary_text', 'type_counts', 'section_census', 'census_state']) AS rule,
    unnest([11, 13, 17, 19, 23, 29, 31, 37, 41, 41]) AS n FROM k)
  SELECT codigo_ibge, rule FROM r WHERE k % n = 0 AND k % 43 <> 0
  UNION ALL SELECT codigo_ibge, 'survey_absent' FROM k WHERE k % 950 = 0 AND k % 43 <> 0
  UNION ALL SELECT codigo_ibge, 'readable' FROM k WHERE k % 43 = 0""")
def document_contract(spark, folder):
    """Every broken rule of the encoded documents, faults of ten kinds planted among them."""
    documents = profiles.unit_profiles(**roles(spark, folder))
    schema = StructType([documents.schema[s] for s in profiles.SECTIONS])
    key = F.col(UNIT).cast("bigint")
    text = F.col("document")
    faulty = (F.when(key % 43 == 0, F.expr("substring(document, 1, length(document) - 1)"))
              .when(key % 41 == 0, F.replace(text, F.lit('"census":{'), F.lit('"census_":{'))).otherwise(text))
    encoded = profiles.encode(_with_faults(documents)).select(UNIT, faulty.alias("document"))
    return profiles.encoded_violations(encoded, schema)


@query("index_sink", f"WITH {DIM} SELECT * EXCLUDE (k, c_acctbal), uf AS shard_state FROM dim")
def index_sink(spark, folder):
    """The index of all units, written as JSON lines and read back, with the state of each unit's shard."""
    work = scratch_path(spark, "index")
    profiles.encode(profiles.unit_profiles(**roles(spark, folder))).write.parquet(f"{work}/encoded")
    encoded = spark.read.parquet(f"{work}/encoded")
    entries = profiles.index_entries(encoded, profiles.plan_shards(encoded))
    write_json_lines(entries, f"{work}/index")
    return spark.read.schema(entries.schema).json(f"{work}/index").select(
        *un.IDENTITY, F.regexp_extract("shard", r"/([A-Z]{2})(?:-[0-9]{3,})?\.json$", 1).alias("shard_state"))
