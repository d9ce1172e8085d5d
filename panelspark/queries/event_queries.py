"""Event histories over customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.numbers import json_number
from panelspark.operators import events as op, keys
from panelspark.operators.benchmark import metric_rows, peer_benchmark
from panelspark.queries.registry import E, P, SNAP, TYPES, U, as_double, events, panel, query, units

_HISTORY = """SELECT u.unit, (SELECT max(day) FROM ev) AS reference_date,
  min(day) AS first_event_date, max(day) AS latest_event_date, count(event_id) AS event_count,
  count(event_id) FILTER (WHERE flagged) AS flagged_event_count,
  count(event_id) FILTER (WHERE day > CAST((SELECT max(day) FROM ev) - INTERVAL 1 YEAR AS DATE)) AS event_count_1y,
  count(event_id) FILTER (WHERE day > CAST((SELECT max(day) FROM ev) - INTERVAL 2 YEAR AS DATE)) AS event_count_2y,
  count(event_id) FILTER (WHERE day > CAST((SELECT max(day) FROM ev) - INTERVAL 5 YEAR AS DATE)) AS event_count_5y,
  count(event_id) FILTER (WHERE flagged AND day > CAST((SELECT max(day) FROM ev) - INTERVAL 1 YEAR AS DATE)) AS flagged_event_count_1y,
  count(event_id) FILTER (WHERE flagged AND day > CAST((SELECT max(day) FROM ev) - INTERVAL 2 YEAR AS DATE)) AS flagged_event_count_2y,
  count(event_id) FILTER (WHERE flagged AND day > CAST((SELECT max(day) FROM ev) - INTERVAL 5 YEAR AS DATE)) AS flagged_event_count_5y,
  CAST(coalesce(sum(amount), 0) AS DOUBLE) AS amount
  FROM units u LEFT JOIN ev e USING (unit) GROUP BY u.unit"""


def snapshot(spark, folder):
    return as_double(op.history_snapshot(
        units(spark, folder), events(spark, folder), "unit", "day", "flagged", "flagged",
        sums=["amount"], windows=(1, 2, 5)), "amount")


@query("history_snapshot", f"WITH {U}, {E} {_HISTORY}")
def history_snapshot(spark, folder):
    return snapshot(spark, folder)


@query("unit_profile_flat", f"""WITH {U}, {E}, {P}, {SNAP}, hist AS ({_HISTORY}),
  latest AS (SELECT * FROM snap WHERE year = (SELECT max(year) FROM snap))
  SELECT u.unit, u.name, u.state, l.year AS land_cover_year,
    l.urban_area_ha / nullif(l.mapped_area_ha, 0) * 100.0 AS urban_area_pct,
    h.reference_date, h.event_count, h.flagged_event_count, h.event_count_5y, h.amount
  FROM units u LEFT JOIN latest l USING (unit) LEFT JOIN hist h USING (unit)""")
def unit_profile_flat(spark, folder):
    """Flagship: every unit with its latest panel year and its event history."""
    from panelspark.operators.panel import panel_snapshot

    rows = panel(spark, folder)
    latest_rows = rows.filter(F.col("year") == rows.agg(F.max("year")).scalar())
    latest = panel_snapshot(latest_rows, F.col("class_id") != "N", {"urban": F.col("class_id") == "R"},
                            unit="unit", match=None, area="area").select(
        "unit", F.col("year").alias("land_cover_year"), "urban_area_pct")
    history = snapshot(spark, folder).select("unit", "reference_date", "event_count",
                                             "flagged_event_count", "event_count_5y", "amount")
    return (units(spark, folder).select("unit", "name", "state")
            .join(latest, "unit", "left").join(history, "unit", "left"))


@query("type_summary", f"""WITH {E} SELECT unit, type, min(day) AS first_event_date,
  max(day) AS latest_event_date, count(*) AS event_count, CAST(sum(amount) AS DOUBLE) AS amount,
  min(status) AS status FROM ev GROUP BY unit, type""")
def type_summary(spark, folder):
    return as_double(op.type_summary(events(spark, folder), ["unit", "type"], "day", ["amount"],
                                     ["status"]), "amount")


@query("month_profile", f"""WITH {U}, {E} SELECT u.unit, CAST(m.month AS INTEGER) AS month,
  count(e.event_id) AS event_count, count(e.event_id) FILTER (WHERE e.flagged) AS flagged_event_count
  FROM units u CROSS JOIN range(1, 13) m(month) LEFT JOIN ev e ON u.unit = e.unit AND m.month = e.month
  GROUP BY u.unit, m.month""")
def month_profile(spark, folder):
    return op.month_profile(units(spark, folder), events(spark, folder), "unit", "month", "flagged",
                            "flagged")


_MONTHS = """prof AS (SELECT u.unit, CAST(m.month AS INTEGER) AS month, count(e.event_id) AS event_count,
  count(e.event_id) FILTER (WHERE e.flagged) AS flagged_event_count
  FROM units u CROSS JOIN range(1, 13) m(month) LEFT JOIN ev e ON u.unit = e.unit AND m.month = e.month
  GROUP BY u.unit, m.month)"""


@query("month_breakdown", f"""WITH {U}, {E}, {_MONTHS}
  SELECT unit, month, event_count, flagged_event_count,
    flagged_event_count / nullif(sum(flagged_event_count) OVER (PARTITION BY unit), 0) * 100.0 AS event_pct
  FROM prof""")
def month_breakdown(spark, folder):
    return op.month_breakdown(month_profile(spark, folder), "unit", "flagged_event_count")


@query("type_breakdown", f"""WITH {U}, {E}, cat AS (SELECT DISTINCT o_orderpriority AS type FROM orders),
  obs AS (SELECT unit, type, min(day) AS first_event_date, max(day) AS latest_event_date, count(*) AS n,
    CAST(sum(amount) AS DOUBLE) AS amount FROM ev GROUP BY unit, type),
  tot AS (SELECT unit, count(*) AS total FROM ev GROUP BY unit)
  SELECT u.unit, c.type, o.first_event_date, o.latest_event_date, coalesce(o.n, 0) AS event_count,
    coalesce(o.amount, 0) AS amount, coalesce(coalesce(o.n, 0) / t.total * 100.0, 0) AS event_pct
  FROM units u CROSS JOIN cat c LEFT JOIN obs o ON o.unit = u.unit AND o.type = c.type
  LEFT JOIN tot t ON t.unit = u.unit""")
def type_breakdown(spark, folder):
    catalogue = spark.createDataFrame([(t,) for t in TYPES], "type string")
    by_type = op.type_summary(events(spark, folder), ["unit", "type"], "day", ["amount"])
    return as_double(op.type_breakdown(units(spark, folder), by_type, "unit", "type", catalogue,
                                       ["event_count", "amount"]), "amount")


_YEARLY = """years AS (SELECT CAST(unnest(range((SELECT min(year) FROM ev), (SELECT max(year) FROM ev) + 1)) AS INTEGER) AS year),
  types AS (SELECT DISTINCT type FROM ev UNION ALL SELECT 'total'),
  cnt AS (SELECT unit, year, type, count(*) AS n FROM ev GROUP BY ALL
          UNION ALL SELECT unit, year, 'total', count(*) FROM ev GROUP BY ALL),
  members AS (SELECT region, count(*) AS members FROM units GROUP BY region),
  tot AS (SELECT u.region, c.year, c.type, CAST(sum(c.n) AS BIGINT) AS total FROM cnt c JOIN units u USING (unit) GROUP BY ALL)"""


@query("annual_region_avg", f"""WITH {U}, {E}, {_YEARLY}
  SELECT m.region, y.year, t.type, m.members, coalesce(x.total, 0) AS total,
    coalesce(x.total, 0) / m.members AS average
  FROM members m CROSS JOIN years y CROSS JOIN types t
  LEFT JOIN tot x ON x.region = m.region AND x.year = y.year AND x.type = t.type""")
def annual_region_avg(spark, folder):
    return op.region_yearly_average(units(spark, folder), events(spark, folder), "unit", "region",
                                    "year", "type", TYPES, "total").select(
        "region", "year", "type", "members", "total", "average")


@query("annual_series", f"""WITH {U}, {E}, {_YEARLY}
  SELECT u.unit, y.year, t.type, coalesce(c.n, 0) AS n, coalesce(x.total, 0) / m.members AS average
  FROM units u JOIN members m USING (region) CROSS JOIN years y CROSS JOIN types t
  LEFT JOIN tot x ON x.region = u.region AND x.year = y.year AND x.type = t.type
  LEFT JOIN cnt c ON c.unit = u.unit AND c.year = y.year AND c.type = t.type""")
def annual_series(spark, folder):
    return op.annual_series(units(spark, folder), events(spark, folder), "unit", "region", "year",
                            "type", TYPES, "total").select("unit", "year", "type", "n", "average")


@query("yearly_total_and_types", f"""WITH {E} SELECT unit, year, coalesce(type, 'total') AS type, count(*) AS n
  FROM ev GROUP BY GROUPING SETS ((unit, year, type), (unit, year))""")
def yearly_total_and_types(spark, folder):
    return op.yearly_counts(events(spark, folder), "unit", "year", "type", "total")


@query("top3_months", f"""WITH {U}, {E}, {_MONTHS},
  r AS (SELECT unit, month, event_count, CAST(row_number() OVER (PARTITION BY unit ORDER BY event_count DESC, month) AS INTEGER) AS position,
    sum(event_count) OVER (PARTITION BY unit) AS total FROM prof)
  SELECT unit, month, event_count, position,
    sum(event_count) OVER (PARTITION BY unit) / total * 100.0 AS top_share_pct
  FROM r WHERE event_count > 0 AND position <= 3""")
def top3_months(spark, folder):
    return op.top_months(month_profile(spark, folder), "unit", "event_count").select(
        "unit", "month", "event_count", "position", "top_share_pct")


_UY = "uy AS (SELECT unit, year, count(*) AS n FROM ev GROUP BY unit, year)"


def _unit_years(spark, folder):
    return events(spark, folder).groupBy("unit", "year").agg(F.count("*").alias("n"))


@query("peak_year", f"""WITH {E}, {_UY}, r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY n DESC, year) AS k FROM uy)
  SELECT unit, year AS peak_year, n AS peak_count FROM r WHERE k = 1""")
def peak_year(spark, folder):
    return op.peak_year(_unit_years(spark, folder), "unit", "year", "n")


@query("first_and_last", f"""WITH {E}, {_UY} SELECT unit, min(year) AS first_year, arg_min(n, year) AS first_value,
  max(year) AS latest_year, arg_max(n, year) AS latest_value FROM uy GROUP BY unit""")
def first_and_last(spark, folder):
    return op.first_and_last(_unit_years(spark, folder), "unit", "year", "n")


@query("scale_to_max", f"""WITH {E}, {_UY} SELECT unit, year, n,
  n / greatest(max(n) OVER (PARTITION BY unit), 1) * 100.0 AS scaled_pct FROM uy""")
def scale_to_max(spark, folder):
    return op.scale_to_max(_unit_years(spark, folder), "unit", "n")


@query("event_rollup", f"""WITH {E} SELECT unit, count(*) AS records, count(*) FILTER (WHERE recognized) AS recognized,
  min(year) AS first_year, max(year) AS last_year, CAST(sum(amount) AS DOUBLE) AS amount FROM ev GROUP BY unit""")
def event_rollup(spark, folder):
    rolled = op.event_rollup(events(spark, folder), "unit", "year", "type", F.col("recognized"),
                             {"amount": F.col("amount")})
    return as_double(rolled.drop("types", "years"), "amount")


@query("counter_maps", f"""WITH {E}, c AS (SELECT unit, type AS label, count(*) AS n FROM ev GROUP BY unit, type)
  SELECT unit, label, n, CAST(row_number() OVER (PARTITION BY unit ORDER BY n DESC, label) - 1 AS INTEGER) AS position FROM c""")
def counter_maps(spark, folder):
    """The ordered counter array of each unit, flattened to rows."""
    arrays = keys.counter_entries(events(spark, folder), ["unit"], "type", "types")
    return arrays.select("unit", F.posexplode("types").alias("position", "e")).select(
        "unit", "e.label", "e.n", "position")


@query("counter_maps_by_year", f"""WITH {E}, c AS (SELECT unit, year AS label, count(*) AS n FROM ev GROUP BY unit, year)
  SELECT unit, string_agg(label || ':' || n, ',' ORDER BY label) AS years FROM c GROUP BY unit""")
def counter_maps_by_year(spark, folder):
    arrays = keys.counter_entries(events(spark, folder), ["unit"], "year", "years", by_count=False)
    return arrays.select("unit", F.array_join(F.transform("years", lambda e: F.concat_ws(
        ":", e["label"].cast("string"), e["n"].cast("string"))), ",").alias("years"))


@query("monetary_reference", f"""WITH {E}, y AS (SELECT year, CAST(sum(amount) AS DOUBLE) AS idx FROM ev GROUP BY year),
  f AS (SELECT year, idx, (SELECT idx FROM y WHERE year = (SELECT max(year) FROM y)) / idx AS factor FROM y)
  SELECT year AS reference_year, idx AS index FROM f WHERE factor = 1 ORDER BY year DESC LIMIT 1""")
def monetary_reference(spark, folder):
    """Reference year of a yearly index series: the last year whose factor is 1."""
    yearly = events(spark, folder).groupBy("year").agg(F.sum("amount").cast("double").alias("index"))
    last = yearly.agg(F.max_by("index", "year")).scalar()
    return op.monetary_reference(yearly.select(
        F.col("year").alias("reference_year"), F.col("index").alias("igp_di_december_index"),
        (last / F.col("index")).alias("correction_factor")))


@query("yearly_impact", f"""WITH {E} SELECT unit, year, count(*) AS event_count, CAST(sum(amount) AS DOUBLE) AS amount,
  count(*) FILTER (WHERE flagged) AS flagged_event_count FROM ev GROUP BY unit, year""")
def yearly_impact(spark, folder):
    return as_double(events(spark, folder).groupBy("unit", "year").agg(
        F.count("*").alias("event_count"), F.sum("amount").alias("amount"),
        F.count_if("flagged").alias("flagged_event_count")), "amount")


@query("events_by_type_with_names", f"""WITH {U}, {E}, s AS (SELECT unit, type, count(*) AS event_count, min(day) AS first_event_date,
    max(day) AS latest_event_date FROM ev GROUP BY unit, type),
  dim AS (SELECT o_orderpriority AS type, split_part(o_orderpriority, '-', 2) AS type_name,
    count(*) AS type_total FROM orders GROUP BY ALL)
  SELECT u.name, u.state, s.type, d.type_name, d.type_total, s.event_count, s.first_event_date, s.latest_event_date
  FROM s JOIN units u USING (unit) LEFT JOIN dim d USING (type)""")
def events_by_type_with_names(spark, folder):
    ev = events(spark, folder)
    summary = op.type_summary(ev, ["unit", "type"], "day")
    names = ev.groupBy("type").agg(F.count("*").alias("type_total")).withColumn(
        "type_name", F.split_part("type", F.lit("-"), F.lit(2)))
    return (summary.join(units(spark, folder).select("unit", "name", "state"), "unit")
            .join(names, "type", "left").drop("unit"))


@query("units_of_a_state", f"""WITH {U} SELECT unit, name, state FROM units WHERE state = 'BUILDING'
  ORDER BY name LIMIT 10""")
def units_of_a_state(spark, folder):
    """Consumer query: first ten units of one state by name."""
    return (units(spark, folder).filter(F.col("state") == "BUILDING").orderBy("name").limit(10)
            .select("unit", "name", "state"))


@query("peer_benchmark_events", f"""WITH {U}, {E}, c AS (SELECT u.unit, u.region, CAST(count(e.event_id) AS DOUBLE) AS value
    FROM units u LEFT JOIN (SELECT * FROM ev WHERE flagged AND day > CAST((SELECT max(day) FROM ev) - INTERVAL 2 YEAR AS DATE)) e USING (unit)
    GROUP BY u.unit, u.region),
  g AS (SELECT region, count(*) AS group_size, avg(value) AS mean, quantile_cont(value, 0.5) AS median FROM c GROUP BY region)
  SELECT c.unit, c.region, c.value, g.group_size, round(g.mean, 9) AS mean, g.median,
    (rank() OVER (PARTITION BY c.region ORDER BY c.value) - 1) / g.group_size * 100.0 AS pct_strictly_lower
  FROM c JOIN g USING (region)""")
def peer_benchmark_events(spark, folder):
    """Each unit's recent flagged events against its region; no event counts as zero."""
    history = op.history_snapshot(units(spark, folder), events(spark, folder), "unit", "day",
                                  "flagged", "flagged", windows=(2,))
    wide = units(spark, folder).select("unit", "region").join(
        history.select("unit", "flagged_event_count_2y"), "unit")
    rows = metric_rows(wide, "unit", "region", {
        "events": (F.col("flagged_event_count_2y"), F.lit("included"))})
    return peer_benchmark(rows, "unit", "region").select(
        "unit", "region", "value", "group_size", F.round("mean", 9).alias("mean"), "median",
        "pct_strictly_lower")


@query("json_numbers", """SELECT unit, to_json({'share': x}) AS document FROM (SELECT o_custkey AS unit,
  CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > 0
    THEN floor(count(*) FILTER (WHERE o_orderstatus = 'O') * 1000.0 / count(*) FILTER (WHERE o_orderstatus = 'F'))::BIGINT END AS x
  FROM orders GROUP BY o_custkey)""")
def json_numbers(spark, folder):
    """Open orders per thousand finished ones of every unit, encoded; without finished orders null, never infinite."""
    counts = events(spark, folder).groupBy("unit").agg(F.count_if(F.col("status") == "O").alias("open"),
                                                       F.count_if(F.col("status") == "F").alias("finished"))
    share = json_number(F.col("open") * 1000.0 / F.nullif("finished", F.lit(0)))
    return counts.select("unit", F.to_json(F.struct(F.floor(share).alias("share")), {"ignoreNullFields": "false"}).alias("document"))
