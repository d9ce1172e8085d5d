"""The documented consumer queries, called as they stand over the tables of the unit profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelspark.operators import panel as pl
from panelspark.plans import consumer
from panelspark.queries.profile_queries import DIM, ROLES, roles
from panelspark.queries.registry import query, table

CODE = "0000001"  # the unit a reader asks for
_ROLE = "CASE o_orderpriority " + " ".join(f"WHEN '{p}' THEN '{c}'" for p, (_, c) in ROLES.items()) + " END"
_COVER = """cover AS (SELECT l_suppkey AS k, 1985 + 5 * (year(l_shipdate) - 1992) AS y, sum(l_quantity) AS area,
    coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS urban, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag IN ('A', 'N')), 0) AS native,
    coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0) AS water FROM lineitem GROUP BY ALL),
  ends AS (SELECT min(y) AS a, max(y) AS b FROM cover),
  full_units AS (SELECT k FROM cover, ends WHERE y IN (a, b, b - 5, b - 10, b - 20) GROUP BY k, a, b
    HAVING count(DISTINCT y) = len(list_distinct([a, b, b - 5, b - 10, b - 20]))),
  hist AS (SELECT printf('%07d', k) AS codigo_ibge, cover.* FROM cover JOIN full_units USING (k))"""
_EVENT = f"""fact AS (SELECT printf('%07d', o_custkey) AS codigo_ibge, o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, {_ROLE} AS cobrade_code,
    o_orderpriority <> '5-LOW' AS is_rain_related FROM orders)"""
_MATCHED = "l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)"


def _silver(spark, folder) -> DataFrame:
    """The panel by unit, group, class and year; suppliers in debt stand for codes the dimension lacks."""
    known = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("municipality_name_source"),
        (F.col("s_acctbal") >= 0).alias("is_dim_municipality_match"))
    return table(spark, folder, "lineitem").join(known, "l_suppkey").select(
        F.format_string("%07d", "l_suppkey").alias("codigo_ibge"), "municipality_name_source", "is_dim_municipality_match",
        F.col("l_linestatus").alias("biome_name"), F.ascii("l_returnflag").alias("class_id"),
        F.col("l_returnflag").alias("class_name"), F.year("l_shipdate").alias("year"), F.col("l_quantity").alias("area_ha"))


@query("consumer_units_of_state", f"WITH {DIM} SELECT codigo_ibge, municipio, uf AS sigla_uf FROM dim WHERE uf = 'BR' ORDER BY municipio LIMIT 10")
def consumer_units_of_state(spark, folder):
    return consumer.units_of_state(roles(spark, folder)["dim"], "BR")


@query("consumer_integrated_profile", f"""WITH {DIM}, {_EVENT}, {_COVER},
    e AS (SELECT codigo_ibge, count(*) AS n, count(*) FILTER (WHERE is_rain_related) AS r, sum(id % 17) AS affected,
      count(*) FILTER (WHERE d > (SELECT max(d) FROM fact) - INTERVAL 10 YEAR) AS recent FROM fact GROUP BY codigo_ibge)
  SELECT codigo_ibge, municipio, uf AS sigla_uf, y AS land_cover_year, urban / area * 100.0 AS urban_area_pct, native / area * 100.0 AS native_vegetation_area_pct,
    water / area * 100.0 AS water_area_pct, (SELECT max(d) FROM fact) AS disaster_reference_date, coalesce(n, 0) AS event_count,
    coalesce(r, 0) AS rain_related_event_count, coalesce(recent, 0) AS event_count_10y, coalesce(affected, 0) AS reported_affected_total
  FROM dim LEFT JOIN (SELECT * FROM hist WHERE y = (SELECT max(y) FROM hist)) h USING (codigo_ibge) LEFT JOIN e USING (codigo_ibge)""")
def consumer_integrated_profile(spark, folder):
    t = roles(spark, folder)
    return consumer.integrated_profile(t["dim"], t["history"], t["snapshot"])


@query("consumer_indicator_series", f"""WITH {_COVER} SELECT y AS year, urban AS urban_area_ha, urban / area * 100.0 AS urban_area_pct,
  native AS native_vegetation_area_ha, water AS water_area_ha FROM hist WHERE codigo_ibge = '{CODE}'""")
def consumer_indicator_series(spark, folder):
    return consumer.indicator_series(roles(spark, folder)["history"], CODE)


@query("consumer_class_series", f"""SELECT year(l_shipdate) AS year, 82 AS class_id, 'R' AS class_name, sum(l_quantity) AS area_ha,
  sum(l_quantity) / 100.0 AS area_km2 FROM lineitem WHERE l_suppkey = {int(CODE)} AND l_returnflag = 'R' AND {_MATCHED} GROUP BY year(l_shipdate)""")
def consumer_class_series(spark, folder):
    return consumer.class_series(pl.panel_fact(_silver(spark, folder), carry=("class_name",)), CODE, ord("R"))


@query("consumer_events_by_type", f"""WITH {DIM}, {_EVENT} SELECT municipio, uf AS sigla_uf, cobrade_code, 'type ' || cobrade_code AS disaster_name,
    bool_and(is_rain_related) AS is_rain_related, count(*) AS event_count, min(d) AS first_event_date, max(d) AS latest_event_date,
    sum(id % 17) AS reported_affected_total FROM fact JOIN dim USING (codigo_ibge) WHERE codigo_ibge = '{CODE}' GROUP BY municipio, uf, cobrade_code""")
def consumer_events_by_type(spark, folder):
    t = roles(spark, folder)
    types = t["fact"].select("cobrade_code", "is_rain_related").distinct().withColumn(
        "disaster_name", F.concat(F.lit("type "), "cobrade_code"))
    return consumer.events_by_type(t["types"], t["dim"], types, CODE)


@query("consumer_yearly_impact", f"""WITH {_EVENT} SELECT CAST(year(d) AS INTEGER) AS event_year, count(*) AS event_count, sum(id % 3) AS deaths,
  sum(id % 17) AS reported_affected_total FROM fact WHERE codigo_ibge = '{CODE}' GROUP BY year(d)""")
def consumer_yearly_impact(spark, folder):
    return consumer.yearly_impact(roles(spark, folder)["fact"], CODE)


@query("consumer_month_profile", f"""WITH {_EVENT} SELECT CAST(m AS INTEGER) AS month, count(d) AS event_count,
  count(*) FILTER (WHERE is_rain_related) AS rain_related_event_count FROM (SELECT unnest(range(1, 13)) AS m)
  LEFT JOIN fact ON month(d) = m AND codigo_ibge = '{CODE}' GROUP BY m""")
def consumer_month_profile(spark, folder):
    return consumer.month_profile(roles(spark, folder)["months"], CODE)


@query("consumer_latest_snapshot", f"""WITH {_COVER} SELECT codigo_ibge, y AS year, area AS mapped_area_ha, urban AS urban_area_ha FROM hist
  QUALIFY row_number() OVER (PARTITION BY codigo_ibge ORDER BY y DESC) = 1""")
def consumer_latest_snapshot(spark, folder):
    return consumer.latest_snapshot(roles(spark, folder)["history"]).select(
        "codigo_ibge", "year", "mapped_area_ha", "urban_area_ha")


@query("consumer_change_ranking", f"""WITH {DIM}, {_COVER} SELECT codigo_ibge, CAST(a AS INTEGER) AS first_year, CAST(b AS INTEGER) AS latest_year,
    max(urban) FILTER (WHERE y = b) - max(urban) FILTER (WHERE y = a) AS urban_area_change_ha, municipio, uf AS sigla_uf
  FROM hist JOIN dim USING (codigo_ibge), ends GROUP BY codigo_ibge, a, b, municipio, uf""")
def consumer_change_ranking(spark, folder):
    t = roles(spark, folder)
    return consumer.change_ranking(t["change"], t["dim"])


@query("consumer_several_biomes", """SELECT printf('%07d', l_suppkey) AS codigo_ibge, string_agg(DISTINCT l_linestatus, '|' ORDER BY l_linestatus) AS biomes
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey HAVING count(DISTINCT l_linestatus) > 1""")
def consumer_several_biomes(spark, folder):
    return consumer.units_in_several_biomes(_silver(spark, folder)).withColumn("biomes", F.array_join("biomes", "|"))


@query("consumer_unmatched_units", """SELECT DISTINCT printf('%07d', s_suppkey) AS codigo_ibge, s_name AS municipality_name_source
  FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_acctbal < 0""")
def consumer_unmatched_units(spark, folder):
    return consumer.unmatched_units(_silver(spark, folder))
