"""Panels over suppliers, line items and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import benchmark as bm, ordering, panel as op
from panelspark.operators.keys import full_outer_with_flags
from panelspark.quality import checks as q
from panelspark.queries.registry import P, SNAP, panel, query, table, wide_panel

def snapshot(spark, folder):
    return op.panel_snapshot(
        panel(spark, folder), F.col("class_id") != "N",
        {"urban": F.col("class_id") == "R", "native": F.col("class_id").isin("A", "N")},
        unit="unit", match=None, area="area")


@query("melt_panel", f"WITH {P} SELECT unit, biome, class_id, year, sum(area) AS area FROM panel GROUP BY ALL")
def melt_panel(spark, folder):
    wide, years = wide_panel(spark, folder)
    return op.melt_panel(wide, ["unit", "biome", "class_id"], years, "area")


@query("panel_silver", """WITH legend AS (SELECT * FROM (VALUES (1,'A'),(2,'N'),(3,'R')) t(class_id, class_name)),
  rows AS (SELECT CAST(l_suppkey AS VARCHAR) AS unit, CAST(l_linenumber % 2 AS VARCHAR) AS biome, l_returnflag AS flag,
    l_linestatus AS region, l_linestatus AS state, CAST(l_linenumber AS VARCHAR) AS src,
    CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS area
    FROM lineitem GROUP BY l_suppkey, l_linenumber, l_returnflag, l_linestatus, year(l_shipdate))
  SELECT r.unit AS codigo_ibge, r.biome AS biome_name, r.year, l.class_id, l.class_name, sum(r.area) AS area_ha,
    CAST(count(*) AS INTEGER) AS source_row_count, string_agg(DISTINCT r.state, '|' ORDER BY r.state) AS states,
    max(CASE WHEN c.c_custkey IS NOT NULL THEN 1 ELSE 0 END) = 1 AS is_dim_municipality_match
  FROM rows r JOIN legend l ON l.class_name = r.flag
  LEFT JOIN customer c ON CAST(c.c_custkey * 2 AS VARCHAR) = r.unit
  GROUP BY r.unit, r.biome, r.year, l.class_id, l.class_name""")
def panel_silver(spark, folder):
    """Wide rows of two groups per unit with repeated grains, melted and matched to units."""
    ids = F.create_map(*[F.lit(x) for p in (("A", 1), ("N", 2), ("R", 3)) for x in p])
    rows = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("geocode"), (F.col("l_linenumber") % 2).cast("string").alias("biome"),
        ids[F.col("l_returnflag")].alias("class"), F.col("l_linestatus").alias("region"),
        F.col("l_linestatus").alias("state"), F.col("l_linenumber").alias("line"),
        F.year("l_shipdate").alias("year"), F.col("l_quantity").alias("area"))
    lo, hi = rows.agg(F.min("year"), F.max("year")).first()
    years = [f"y{y}" for y in range(lo, hi + 1)]
    wide = rows.groupBy("geocode", "biome", "class", "region", "state", "line").agg(
        F.min("geocode").cast("string").alias("municipality"),
        *[F.sum(F.when(F.col("year") == int(y[1:]), F.col("area"))).alias(y) for y in years])
    legend = spark.createDataFrame(
        [(1, "A"), (2, "N"), (3, "R")], "class_id int, class_name string").withColumns({
            "class_level": F.lit(1), **{f"class_level_{i}_name": F.col("class_name") for i in range(5)}})
    dim = table(spark, folder, "customer").select((F.col("c_custkey") * 2).cast("string").alias("codigo_ibge"))
    silver = op.panel_silver(wide, legend, dim, years)
    return silver.select("codigo_ibge", "biome_name", "year", "class_id", "class_name", "area_ha",
                         "source_row_count", F.array_join("source_state_names", "|").alias("states"),
                         "is_dim_municipality_match")


@query("panel_fact", f"""WITH {P} SELECT unit, year, class_id, sum(area) AS area_ha, sum(area) / 100.0 AS area_km2
  FROM panel GROUP BY unit, year, class_id""")
def panel_fact(spark, folder):
    return op.panel_fact(panel(spark, folder), unit="unit", match=None, carry=(), area="area")


_SNAP_COLUMNS = """unit, year, mapped_area_ha, urban_area_ha, urban_area_ha / 100.0 AS urban_area_km2,
  urban_area_ha / nullif(mapped_area_ha, 0) * 100.0 AS urban_area_pct, native_area_ha,
  native_area_ha / 100.0 AS native_area_km2, native_area_ha / nullif(mapped_area_ha, 0) * 100.0 AS native_area_pct"""


@query("panel_snapshot", f"WITH {P}, {SNAP} SELECT {_SNAP_COLUMNS} FROM snap")
def panel_snapshot(spark, folder):
    return snapshot(spark, folder)


_CHANGE = """b AS (SELECT min(year) AS first_year, max(year) AS latest_year FROM snap),
  chg AS (SELECT l.unit, b.first_year, b.latest_year, b.latest_year - 1 AS reference_year_1y,
    b.latest_year - 3 AS reference_year_3y, b.latest_year - 5 AS reference_year_5y,
    f.urban_area_ha AS urban_first_year_ha, l.urban_area_ha AS urban_latest_year_ha,
    l.urban_area_ha - f.urban_area_ha AS urban_change_ha,
    (l.urban_area_ha - f.urban_area_ha) / nullif(f.urban_area_ha, 0) * 100.0 AS urban_change_pct,
    l.urban_area_ha - r1.urban_area_ha AS urban_change_1y_ha,
    (l.urban_area_ha - r1.urban_area_ha) / nullif(r1.urban_area_ha, 0) * 100.0 AS urban_change_1y_pct,
    l.urban_area_ha - r3.urban_area_ha AS urban_change_3y_ha,
    (l.urban_area_ha - r3.urban_area_ha) / nullif(r3.urban_area_ha, 0) * 100.0 AS urban_change_3y_pct,
    l.urban_area_ha - r5.urban_area_ha AS urban_change_5y_ha,
    (l.urban_area_ha - r5.urban_area_ha) / nullif(r5.urban_area_ha, 0) * 100.0 AS urban_change_5y_pct,
    l.native_area_ha - r3.native_area_ha AS native_change_3y_ha
  FROM snap l CROSS JOIN b JOIN snap f ON f.unit = l.unit AND f.year = b.first_year
  JOIN snap r1 ON r1.unit = l.unit AND r1.year = b.latest_year - 1
  JOIN snap r3 ON r3.unit = l.unit AND r3.year = b.latest_year - 3
  JOIN snap r5 ON r5.unit = l.unit AND r5.year = b.latest_year - 5
  WHERE l.year = b.latest_year)"""


def change(spark, folder):
    return op.panel_change(
        snapshot(spark, folder),
        (op.ChangeMetric("urban_area_ha", "urban"),
         op.ChangeMetric("native_area_ha", "native", (3,), full=False, pct=False)),
        horizons=(1, 3, 5), unit="unit", years_from=panel(spark, folder))


@query("panel_change", f"WITH {P}, {SNAP}, {_CHANGE} SELECT * FROM chg")
def panel_change(spark, folder):
    return change(spark, folder)


@query("indicator_series", f"WITH {P}, {SNAP} SELECT unit, year, urban_area_ha, urban_area_ha / nullif(mapped_area_ha, 0) * 100.0 AS urban_area_pct FROM snap")
def indicator_series(spark, folder):
    return snapshot(spark, folder).select("unit", "year", "urban_area_ha", "urban_area_pct")


@query("class_series", f"""WITH {P} SELECT unit, year, class_id, sum(area) AS area_ha, sum(area) / 100.0 AS area_km2
  FROM panel WHERE class_id = 'R' GROUP BY unit, year, class_id""")
def class_series(spark, folder):
    """Consumer query: one class of the panel; the filter reaches the file scan."""
    rows = panel(spark, folder).filter(F.col("class_id") == "R")
    return op.panel_fact(rows, unit="unit", match=None, carry=(), area="area")


@query("latest_snapshot", f"WITH {P}, {SNAP}, r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY year DESC) AS k FROM snap) "
       "SELECT s.s_name AS name, r.unit, r.year, r.mapped_area_ha FROM r JOIN supplier s ON s.s_suppkey = r.unit WHERE k = 1")
def latest_snapshot(spark, folder):
    latest = snapshot(spark, folder).groupBy("unit").agg(
        F.max("year").alias("year"), F.max_by("mapped_area_ha", "year").alias("mapped_area_ha"))
    names = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_name").alias("name"))
    return latest.join(names, "unit")


@query("change_ranking", f"""WITH {P}, {SNAP}, {_CHANGE} SELECT s.s_name AS name, c.unit, c.urban_change_ha
  FROM chg c JOIN supplier s ON s.s_suppkey = c.unit ORDER BY c.urban_change_ha DESC, c.unit""")
def change_ranking(spark, folder):
    names = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_name").alias("name"))
    return (change(spark, folder).join(names, "unit").select("name", "unit", "urban_change_ha")
            .orderBy(F.desc("urban_change_ha"), "unit"))


@query("snapshot_with_change", f"""WITH {P}, {SNAP}, {_CHANGE} SELECT s.unit, p.s_name AS name, c.first_year, c.latest_year,
  s.urban_area_ha, c.urban_change_ha FROM snap s JOIN chg c USING (unit) JOIN supplier p ON p.s_suppkey = s.unit
  WHERE s.year = c.latest_year""")
def snapshot_with_change(spark, folder):
    names = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_name").alias("name"))
    changes = change(spark, folder).select("unit", "first_year", "latest_year", "urban_change_ha")
    return (snapshot(spark, folder).select("unit", "year", "urban_area_ha").join(changes, "unit")
            .filter(F.col("year") == F.col("latest_year")).drop("year").join(names, "unit"))


@query("change_for_period", f"""WITH {P}, {SNAP}, {_CHANGE} SELECT unit, reference_year_3y AS start_year,
  urban_change_3y_ha AS change_ha, urban_change_3y_pct AS change_pct FROM chg""")
def change_for_period(spark, folder):
    return op.change_for_period(change(spark, folder), 3, "urban", unit="unit")


@query("history_since", f"""WITH {P}, {SNAP} SELECT unit, year, urban_area_ha / 100.0 AS value FROM snap
  WHERE year >= (SELECT max(year) - 3 FROM snap)""")
def history_since(spark, folder):
    history = snapshot(spark, folder)
    start = history.agg(F.max("year") - 3).scalar()
    return op.history_since(history, start, share=False, group="urban", unit="unit")


@query("missing_references_hidden", f"""WITH {P}, {SNAP}, {_CHANGE}, h AS (SELECT unit, list(year) AS years FROM snap WHERE urban_area_ha > 0 GROUP BY unit)
  SELECT c.unit, CASE WHEN list_contains(h.years, reference_year_5y) THEN reference_year_5y END AS reference_year_5y,
    CASE WHEN list_contains(h.years, reference_year_5y) THEN urban_change_5y_ha END AS urban_change_5y_ha,
    CASE WHEN list_contains(h.years, reference_year_5y) THEN urban_change_5y_pct END AS urban_change_5y_pct
  FROM chg c JOIN h USING (unit)""")
def missing_references_hidden(spark, folder):
    years = snapshot(spark, folder).filter("urban_area_ha > 0").groupBy("unit").agg(
        F.collect_set("year").alias("years"))
    joined = change(spark, folder).join(years, "unit")
    return op.hide_missing_references(joined, F.col("years"), (5,), ("urban",)).select(
        "unit", "reference_year_5y", "urban_change_5y_ha", "urban_change_5y_pct")


@query("multi_group_lists", f"""WITH {P}, d AS (SELECT DISTINCT unit, class_id || biome AS g FROM panel)
  SELECT unit, string_agg(g, '|' ORDER BY g) AS groups, count(*) AS n FROM d GROUP BY unit HAVING count(*) > 1""")
def multi_group_lists(spark, folder):
    rows = panel(spark, folder).withColumn("g", F.concat("class_id", "biome"))
    return op.multi_group_units(rows, "unit", "g").select(
        "unit", F.array_join("groups", "|").alias("groups"), F.size("groups").cast("bigint").alias("n"))


def _hierarchy(spark, folder):
    """Classes of the parts table: size as class, levels built from it."""
    size = F.col("p_size")
    branch = F.concat((size % 5).cast("string"), F.lit(". Branch "), (size % 5).cast("string"))
    deep = F.when(size % 2 == 0, F.concat(branch, F.lit("."), size.cast("string"))).otherwise(branch)
    leaf = F.when(size % 4 == 0, F.concat(F.lit("1.2. "), size.cast("string"), F.lit(" leaf"))).otherwise(deep)
    rows = table(spark, folder, "part").select(
        size.alias("class"), F.lit("All").alias("class_level_0"), branch.alias("class_level_1"),
        deep.alias("class_level_2"), leaf.alias("class_level_3"), leaf.alias("class_level_4"))
    return op.class_hierarchy(rows)


def _legend(spark, folder):
    return table(spark, folder, "nation").select(
        (F.col("n_nationkey") * 3).cast("int").alias("class_id"), F.col("n_name").alias("class_name_pt_br"),
        F.lower("n_name").alias("class_name_en"), F.lit("#000000").alias("hex_code"))


_NAMES = {"urban": "nation_1", "water": "NATION_2", "wetland": "Nation_3"}
_BRANCHES = {"native_vegetation": ("1. Branch 1", "2. Branch 2"), "agriculture_livestock": ("3. Branch 3",)}


def _semantics(spark, folder):
    return op.class_semantics(_hierarchy(spark, folder), _legend(spark, folder), _NAMES, _BRANCHES,
                              not_observed="Branch 4")


_HIER = """br AS (SELECT DISTINCT p_size AS class_id, 'All' AS l0, (p_size % 5) || '. Branch ' || (p_size % 5) AS l1 FROM part),
  h2 AS (SELECT *, CASE WHEN class_id % 2 = 0 THEN l1 || '.' || class_id ELSE l1 END AS l2 FROM br),
  h AS (SELECT *, CASE WHEN class_id % 4 = 0 THEN '1.2. ' || class_id || ' leaf' ELSE l2 END AS l4 FROM h2),
  leg AS (SELECT CAST(n_nationkey * 3 AS INTEGER) AS class_id, n_name AS pt, lower(n_name) AS en FROM nation)"""


@query("class_legend_full_join", f"""WITH {_HIER}
  SELECT coalesce(h.class_id, leg.class_id) AS class_id, coalesce(pt, regexp_replace(l4, '^[0-9.]+\\s*', '')) AS class_name,
    CASE WHEN l4 IS DISTINCT FROM l4 THEN 4 WHEN l4 IS DISTINCT FROM l2 THEN 3 WHEN l2 IS DISTINCT FROM l1 THEN 2
      WHEN l1 IS NOT NULL THEN 1 END AS class_level,
    h.class_id IS NOT NULL AS is_in_statistics, leg.class_id IS NOT NULL AS is_in_legend_csv,
    coalesce(h.class_id, leg.class_id) IN (SELECT class_id FROM h WHERE l1 <> '4. Branch 4') AS is_mapped_class,
    coalesce(h.class_id, leg.class_id) IN (SELECT class_id FROM h WHERE l1 IN ('1. Branch 1', '2. Branch 2')) AS is_native_vegetation,
    coalesce(h.class_id, leg.class_id) IN (SELECT class_id FROM h WHERE l1 = '3. Branch 3') AS is_agriculture_livestock,
    CASE WHEN leg.class_id IS NOT NULL THEN 'official_legend_csv' ELSE 'statistics_workbook_hierarchy' END AS class_name_source
  FROM h FULL JOIN leg ON h.class_id = leg.class_id""")
def class_legend_full_join(spark, folder):
    legend = op.class_legend(_hierarchy(spark, folder), _legend(spark, folder), _semantics(spark, folder))
    return legend.select("class_id", "class_name", "class_level", "is_in_statistics", "is_in_legend_csv",
                         "is_mapped_class", "is_native_vegetation", "is_agriculture_livestock",
                         "class_name_source")


@query("class_semantics", f"""WITH {_HIER}
  SELECT 'urban' AS indicator, class_id FROM leg WHERE lower(pt) = 'nation_1' UNION ALL
  SELECT 'water', class_id FROM leg WHERE lower(pt) = 'nation_2' UNION ALL
  SELECT 'wetland', class_id FROM leg WHERE lower(pt) = 'nation_3' UNION ALL
  SELECT 'native_vegetation', class_id FROM h WHERE l1 IN ('1. Branch 1', '2. Branch 2') UNION ALL
  SELECT 'agriculture_livestock', class_id FROM h WHERE l1 = '3. Branch 3' UNION ALL
  SELECT 'not_observed', class_id FROM h WHERE regexp_matches(l1, 'branch 4', 'i') UNION ALL
  SELECT 'mapped', class_id FROM h WHERE NOT regexp_matches(l1, 'branch 4', 'i')""")
def class_semantics(spark, folder):
    """Which classes each indicator stands for."""
    return op.indicator_classes(_hierarchy(spark, folder), _legend(spark, folder), _NAMES, _BRANCHES,
                                "Branch 4").withColumn("class_id", F.col("class_id").cast("int"))


@query("full_outer_flags", f"""WITH {_HIER} SELECT coalesce(h.class_id, leg.class_id) AS class_id,
  h.class_id IS NOT NULL AS in_hierarchy, leg.class_id IS NOT NULL AS in_legend FROM h FULL JOIN leg ON h.class_id = leg.class_id""")
def full_outer_flags(spark, folder):
    return full_outer_with_flags(_hierarchy(spark, folder).select("class_id"),
                                 _legend(spark, folder).select("class_id"), "class_id",
                                 "in_hierarchy", "in_legend")


_VAR = """v AS (SELECT unit, min(mapped_area_ha) AS min_value, max(mapped_area_ha) AS max_value,
  (max(mapped_area_ha) - min(mapped_area_ha)) / nullif(avg(mapped_area_ha), 0) * 100.0 AS variation_pct FROM snap GROUP BY unit)"""


@query("stability_quantiles", f"""WITH {P}, {SNAP}, {_VAR} SELECT round(quantile_cont(variation_pct, 0.5), 6) AS p50,
  round(quantile_cont(variation_pct, 0.9), 6) AS p90, round(quantile_cont(variation_pct, 0.95), 6) AS p95,
  round(quantile_cont(variation_pct, 0.99), 6) AS p99 FROM v""")
def stability_quantiles(spark, folder):
    per_unit = q.variation(snapshot(spark, folder), "unit", "mapped_area_ha")
    result = ordering.exact_quantiles(per_unit, [], "variation_pct",
                                      {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    return result.select(*[F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "p99")])


@query("top_variation", f"""WITH {P}, {SNAP}, {_VAR} SELECT unit, min_value, max_value, round(variation_pct, 6) AS variation_pct
  FROM v ORDER BY v.variation_pct DESC, unit LIMIT 20""")
def top_variation(spark, folder):
    return q.largest_variations(snapshot(spark, folder), "unit", "mapped_area_ha").withColumn(
        "variation_pct", F.round("variation_pct", 6))


@query("group_quantiles", """SELECT l_returnflag AS class_id, quantile_cont(l_extendedprice, 0.5) AS p50,
  quantile_cont(l_extendedprice, 0.9) AS p90, quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY l_returnflag""")
def group_quantiles(spark, folder):
    """Exact quantiles of three very large groups."""
    rows = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("class_id"), "l_extendedprice")
    return ordering.exact_quantiles(rows, ["class_id"], "l_extendedprice", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query("peer_benchmark_panel", f"""WITH {P}, {SNAP}, s AS (SELECT snap.* FROM snap JOIN supplier ON s_suppkey = unit WHERE s_acctbal >= 0),
  latest AS (SELECT unit, max(year) AS latest_snapshot_year, arg_max(mapped_area_ha, year) AS mapped,
    arg_max(urban_area_ha / nullif(mapped_area_ha, 0) * 100.0, year) AS pct FROM s GROUP BY unit),
  st AS (SELECT p.s_suppkey AS unit, p.s_nationkey AS region,
    CASE WHEN l.unit IS NULL THEN 'missing' WHEN coalesce(l.mapped, 0) = 0 OR l.pct IS NULL OR p.s_acctbal > 9000 THEN 'undefined' ELSE 'included' END AS state, l.pct
    FROM supplier p LEFT JOIN latest l ON l.unit = p.s_suppkey),
  v AS (SELECT unit, region, state, CASE WHEN state = 'included' THEN pct END AS value FROM st),
  g AS (SELECT region, count(*) AS group_size, count(value) AS included, count(*) FILTER (WHERE state = 'missing') AS missing,
    count(*) FILTER (WHERE state = 'undefined') AS undefined, avg(value) AS mean, quantile_cont(value, 0.5) AS median FROM v GROUP BY region)
  SELECT v.unit, v.region, v.state, round(v.value, 6) AS value, g.group_size, g.included, g.missing, g.undefined,
    round(g.mean, 6) AS mean, round(g.median, 6) AS median,
    CASE WHEN v.state = 'included' THEN (SELECT count(*) FROM v w WHERE w.region = v.region AND w.value < v.value) / g.included * 100.0 END AS pct_strictly_lower
  FROM v JOIN g USING (region)""")
def peer_benchmark_panel(spark, folder):
    """Latest share of each unit against its region; some units miss the panel or are undefined."""
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("unit"), F.col("s_nationkey").alias("region"), "s_acctbal")
    covered = suppliers.filter(F.col("s_acctbal") >= 0).select("unit")
    history = snapshot(spark, folder).join(covered, "unit")
    latest = history.groupBy("unit").agg(
        F.max_by("mapped_area_ha", "year").alias("mapped"), F.max_by("urban_area_pct", "year").alias("pct"))
    joined = suppliers.join(latest.withColumn("hit", F.lit(True)), "unit", "left")
    undefined = (F.coalesce("mapped", F.lit(0.0)) == 0) | F.col("pct").isNull() | (F.col("s_acctbal") > 9000)
    state = F.when(F.col("hit").isNull(), bm.MISSING).when(undefined, bm.UNDEFINED).otherwise(bm.INCLUDED)
    rows = bm.metric_rows(joined.withColumn("state", state), "unit", "region", {
        "share": (F.when(F.col("state") == bm.INCLUDED, F.col("pct")), F.col("state"))})
    return bm.peer_benchmark(rows, "unit", "region").select(
        "unit", "region", "state", F.round("value", 6).alias("value"), "group_size", "included", "missing",
        "undefined", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"),
        "pct_strictly_lower")


@query("unmatched_audit", """SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS codigo_ibge FROM lineitem
  WHERE l_suppkey NOT IN (SELECT c_custkey * 2 FROM customer)""")
def unmatched_audit(spark, folder):
    from panelspark.operators.keys import left_with_match

    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("unit")).distinct()
    dim = table(spark, folder, "customer").select((F.col("c_custkey") * 2).alias("unit"))
    flagged = left_with_match(rows, dim, "unit", "unit")
    return flagged.filter(~F.col("is_match")).select(F.col("unit").cast("string").alias("codigo_ibge")).distinct()
