"""Quality checks and releases over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import keys, release
from panelspark.quality import checks as q
from panelspark.queries.event_queries import month_profile, snapshot as event_snapshot, type_summary
from panelspark.queries.key_queries import typed_comparison
from panelspark.queries.panel_queries import snapshot as panel_snapshot
from panelspark.queries.registry import E, P, SNAP, TYPES, events, panel, query, table, units


def _observed(df, *labels):
    """Counters of one check as typed columns."""
    schema = "struct<" + ",".join(f"{x}: bigint" for x in labels) + ">"
    return df.select("name", "status", F.from_json("observed", schema).alias("o")).select("name", "status", "o.*")


def _verdict(name, counters, condition):
    return f"SELECT '{name}' AS name, CASE WHEN {condition} THEN 'PASS' ELSE 'FAIL' END AS status, {counters}"


@query("null_profile", """SELECT 'not_null' AS name, CASE WHEN a + b + c = 0 THEN 'PASS' ELSE 'FAIL' END AS status, a AS quality, b AS toxic, c AS text
  FROM (SELECT count(*) FILTER (WHERE quality IS NULL) AS a, count(*) FILTER (WHERE toxic IS NULL) AS b,
    count(*) FILTER (WHERE coalesce(text, '') = '') AS c FROM documents LEFT JOIN labels USING (doc_id))""")
def null_profile(spark, folder):
    joined = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return _observed(q.aggregate_checks(joined, "documents", [
        q.not_null(["quality", "toxic", "text"], ["text"])]), "quality", "toxic", "text")


@query("regex_profile", """SELECT 'code_shapes' AS name, CASE WHEN a + b + c = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
  a AS invalid_c_name, b AS invalid_c_mktsegment, c AS name_key_conflicts FROM (
  SELECT count(*) FILTER (WHERE NOT regexp_full_match(c_name, 'Customer#[0-9]{9}')) AS a,
    count(*) FILTER (WHERE NOT regexp_full_match(c_mktsegment, '[A-H][A-Z]+')) AS b,
    count(*) FILTER (WHERE CAST(substr(c_name, 10) AS BIGINT) <> c_custkey) AS c FROM customer)""")
def regex_profile(spark, folder):
    check = q.matches({"c_name": "Customer#[0-9]{9}", "c_mktsegment": "[A-H][A-Z]+"}, conflicts={
        "name_key_conflicts": F.substring("c_name", 10, 9).cast("bigint") != F.col("c_custkey")})
    return _observed(q.aggregate_checks(table(spark, folder, "customer"), "customer", [check]),
                     "invalid_c_name", "invalid_c_mktsegment", "name_key_conflicts")


@query("nonneg_profile", """SELECT 'non_negative' AS name, CASE WHEN a + b = 0 THEN 'PASS' ELSE 'FAIL' END AS status, a AS c_acctbal, b AS c_custkey
  FROM (SELECT count(*) FILTER (WHERE c_acctbal < 0) AS a, count(*) FILTER (WHERE c_custkey < 0) AS b FROM customer)""")
def nonneg_profile(spark, folder):
    return _observed(q.aggregate_checks(table(spark, folder, "customer"), "customer", [
        q.non_negative(["c_acctbal", "c_custkey"])]), "c_acctbal", "c_custkey")


@query("allowed_values", """SELECT 'allowed_values' AS name, CASE WHEN a + b = 0 THEN 'PASS' ELSE 'FAIL' END AS status, a AS o_orderstatus, b AS o_orderpriority
  FROM (SELECT count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS a, count(*) FILTER (WHERE o_orderpriority NOT IN ('F', 'O')) AS b FROM orders)""")
def allowed_values(spark, folder):
    return _observed(q.aggregate_checks(table(spark, folder, "orders"), "orders", [
        q.allowed_values(["o_orderstatus", "o_orderpriority"], ("F", "O"))]), "o_orderstatus", "o_orderpriority")


@query("row_identity", """SELECT 'row_identity' AS name, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, n AS total FROM (
  SELECT count(*) FILTER (WHERE abs(t - (a + b)) > 0.05) AS n FROM (SELECT CAST(round(l_extendedprice * 1.1, 1) AS DECIMAL(18,2)) AS t,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS a, CAST(round(l_extendedprice * 0.1, 1) AS DECIMAL(18,2)) AS b FROM lineitem))""")
def row_identity(spark, folder):
    """A rounded total against its parts: within five cents, or not."""
    price = F.col("l_extendedprice")
    money = lambda c: c.cast("decimal(18,2)")
    rows = table(spark, folder, "lineitem").select(
        money(F.round(price * 1.1, 1)).alias("total"), money(price).alias("a"),
        money(F.round(price * 0.1, 1)).alias("b"))
    return _observed(q.aggregate_checks(rows, "lineitem", [q.row_identity({"total": ("a", "b")}, 0.05)]), "total")


@query("bounded_values", f"""WITH {P}, {SNAP} SELECT 'bounded' AS name, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, n AS urban_area_pct
  FROM (SELECT count(*) FILTER (WHERE p < -1e-9 OR p > 100 + 1e-9) AS n FROM (SELECT urban_area_ha / nullif(mapped_area_ha, 0) * 100.0 AS p FROM snap))""")
def bounded_values(spark, folder):
    return _observed(q.aggregate_checks(panel_snapshot(spark, folder), "snapshot", [
        q.bounded(["urban_area_pct"], 0, 100, 1e-9)]), "urban_area_pct")


@query("derived_dates", f"""WITH {E} SELECT 'derived_dates' AS name, CASE WHEN lo = 1995 AND hi = 2001 THEN 'PASS' ELSE 'FAIL' END AS status,
  CAST(lo AS BIGINT) AS first_year, CAST(hi AS BIGINT) AS latest_year, CAST(0 AS BIGINT) AS event_year_differences, CAST(0 AS BIGINT) AS event_month_differences, CAST(0 AS BIGINT) AS invalid_months
  FROM (SELECT min(year) AS lo, max(year) AS hi FROM ev)""")
def derived_dates(spark, folder):
    return _observed(q.aggregate_checks(events(spark, folder), "events", [
        q.derived_dates("day", "year", "month", 1995, 2001)]), "first_year", "latest_year",
        "event_year_differences", "event_month_differences", "invalid_months")


@query("series_complete", f"""WITH {E}, y AS (SELECT DISTINCT year FROM ev) SELECT 'series_complete' AS name,
  CASE WHEN (SELECT count(*) FROM y WHERE year BETWEEN 1994 AND 2002) = 9 THEN 'PASS' ELSE 'FAIL' END AS status,
  CAST((SELECT min(year) FROM y) AS BIGINT) AS min_year, CAST((SELECT max(year) FROM y) AS BIGINT) AS max_year, (SELECT count(*) FROM y) AS year_count,
  (SELECT string_agg(g, ',' ORDER BY g) FROM range(1994, 2003) t(g) WHERE g NOT IN (SELECT year FROM y)) AS gaps""")
def series_complete(spark, folder):
    df = q.aggregate_checks(events(spark, folder), "events", [q.series_complete("year", 1994, 2002)])
    schema = "min_year bigint, max_year bigint, year_count bigint, gaps array<int>"
    return df.select("name", "status", F.from_json("observed", schema).alias("o")).select(
        "name", "status", "o.min_year", "o.max_year", "o.year_count",
        F.array_join(F.col("o.gaps"), ",").alias("gaps"))


@query("expected_counts", """SELECT 'expected_counts' AS name, CASE WHEN a = 20 AND b = 341 THEN 'PASS' ELSE 'FAIL' END AS status, a AS both, b AS good
  FROM (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS a, count(*) FILTER (WHERE quality = 1) AS b FROM labels)""")
def expected_counts(spark, folder):
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return _observed(q.aggregate_checks(table(spark, folder, "labels"), "labels", [
        q.expected_counts({"both": (good & toxic, 20), "good": (good, 341)})]), "both", "good")


@query("unique_check", f"WITH {E}, d AS (SELECT unit, day FROM ev GROUP BY ALL HAVING count(*) > 1) " +
       _verdict("unit_day_is_unique", "count(*) AS duplicate_keys FROM d", "count(*) = 0"))
def unique_check(spark, folder):
    return _observed(q.unique(events(spark, folder), "events", ["unit", "day"], "unit_day_is_unique"), "duplicate_keys")


@query("dimension_agrees", f"""WITH {E}, dim AS (SELECT n_nationkey AS type_id, n_name AS label FROM nation),
  f AS (SELECT p_size AS type_id, CASE WHEN p_size < 10 THEN 'NATION_' || p_size ELSE p_brand END AS label FROM part)
  SELECT 'dimension_agrees' AS name, CASE WHEN a + b = 0 THEN 'PASS' ELSE 'FAIL' END AS status, a AS missing_codes, b AS mapping_conflicts FROM (
  SELECT count(*) FILTER (WHERE d.type_id IS NULL) AS a, count(*) FILTER (WHERE d.type_id IS NOT NULL AND f.label <> d.label) AS b
  FROM f LEFT JOIN dim d USING (type_id))""")
def dimension_agrees(spark, folder):
    fact = table(spark, folder, "part").select(F.col("p_size").alias("type_id"), F.when(
        F.col("p_size") < 10, F.concat(F.lit("NATION_"), F.col("p_size").cast("string"))).otherwise(
        F.col("p_brand")).alias("label"))
    dim = table(spark, folder, "nation").select(F.col("n_nationkey").alias("type_id"), F.col("n_name").alias("label"))
    return _observed(q.dimension_agrees(fact, dim, "type_id", {"label": "label"}, "part", "dimension_agrees"),
                     "missing_codes", "mapping_conflicts")


@query("counts_reconcile", """SELECT 'event_counts_reconcile' AS name, 'PASS' AS status, n AS snapshot, n AS types, n AS months, n AS events
  FROM (SELECT count(*) AS n FROM orders)""")
def counts_reconcile(spark, folder):
    total = F.sum("event_count")
    return _observed(q.counts_reconcile(spark, {
        "snapshot": (event_snapshot(spark, folder), total), "types": (type_summary(spark, folder), total),
        "months": (month_profile(spark, folder), total), "events": (events(spark, folder), F.count("*"))},
        [("snapshot", "types", "months", "events")], "gold", "event_counts_reconcile"),
        "snapshot", "types", "months", "events")


@query("coverage_check", """SELECT 'coverage' AS name, CASE WHEN m / r * 100.0 >= 99 THEN 'PASS' ELSE 'FAIL' END AS status,
  m AS matched_keys, r AS right_keys, m / r * 100.0 AS coverage_pct FROM (SELECT
  (SELECT count(DISTINCT l.doc_id) FROM labels l JOIN documents d USING (doc_id)) AS m, (SELECT count(DISTINCT doc_id) FROM documents) AS r)""")
def coverage_check(spark, folder):
    df = q.coverage(table(spark, folder, "labels"), table(spark, folder, "documents"), "doc_id", 99.0,
                    "labels", "coverage")
    return df.select("name", "status", F.from_json(
        "observed", "matched_keys bigint, right_keys bigint, coverage_pct double").alias("o")).select("name", "status", "o.*")


@query("rollup_agrees", """WITH f AS (SELECT l_orderkey AS k, sum(l_quantity) AS fine FROM lineitem GROUP BY 1),
  c AS (SELECT o_orderkey AS k, CAST(round(o_totalprice / 4000) AS DOUBLE) AS coarse FROM orders)
  SELECT coalesce(f.k, c.k) AS k, coalesce(fine, 0) - coalesce(coarse, 0) AS gap FROM f FULL JOIN c ON f.k = c.k
  WHERE abs(coalesce(fine, 0) - coalesce(coarse, 0)) > 1e-8""")
def rollup_agrees(spark, folder):
    """Sums of line items against a figure of the order, either side possibly absent."""
    fine = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("x"))
    coarse = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") / 4000).alias("x"))
    diff = q.rollup_differences(fine, coarse, ["k"], "x", 1e-8)
    return diff.select("k", (F.coalesce("__fine", F.lit(0.0)) - F.coalesce("__coarse", F.lit(0.0))).alias("gap"))


@query("contains_keys", """SELECT 'segments_present' AS name, CASE WHEN count(DISTINCT c_mktsegment) = 3 THEN 'PASS' ELSE 'FAIL' END AS status,
  count(DISTINCT c_mktsegment) AS found FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'NOWHERE')""")
def contains_keys(spark, folder):
    return _observed(q.contains_keys(table(spark, folder, "customer"), "customer", "c_mktsegment",
                                     ("BUILDING", "MACHINERY", "NOWHERE"), "segments_present"), "found")


@query("typed_copy_check", """SELECT 'copies_agree' AS name, 'FAIL' AS status, count(*) AS compared_rows,
  count(*) FILTER (WHERE o_totalprice > 400000 OR (o_custkey > 1400 AND o_orderstatus <> 'P')) AS differing_rows FROM orders""")
def typed_copy_check(spark, folder):
    return _observed(q.typed_copy_agrees(typed_comparison(spark, folder), "orders", "copies_agree"),
                     "compared_rows", "differing_rows")


@query("anomaly_report", f"""WITH {E} SELECT (SELECT count(*) FROM ev WHERE NOT recognized) AS unrecognized,
  (SELECT count(*) FROM ev WHERE amount < 2000) AS small_amount,
  (SELECT count(*) FROM (SELECT unit, day, type FROM ev GROUP BY ALL HAVING count(*) > 1)) AS natural_key_duplicate_groups,
  (SELECT count(*) FROM (SELECT unit FROM ev GROUP BY unit HAVING count(DISTINCT status) > 1)) AS codes_with_name_variants""")
def anomaly_report(spark, folder):
    return q.anomaly_report(events(spark, folder), {"unrecognized": ~F.col("recognized"),
                                                    "small_amount": F.col("amount") < 2000},
                            ["unit", "day", "type"], "unit", "status")


@query("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, folder):
    return q.status_counts(events(spark, folder), "status")


@query("warnings", """SELECT 'unlabelled' AS name, (n - m) || ' documents have no label' AS text FROM (SELECT
  (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM labels) AS m) WHERE n > m""")
def warnings(spark, folder):
    row = q.side_by_side(spark, {"n": (table(spark, folder, "documents"), F.count("*")),
                                 "m": (table(spark, folder, "labels"), F.count("*"))})
    return q.warnings_from(row, {
        "unlabelled": (F.col("n") > F.col("m"), F.concat((F.col("n") - F.col("m")).cast("string"),
                                                         F.lit(" documents have no label"))),
        "overlabelled": (F.col("n") < F.col("m"), F.lit("more labels than documents"))})


def order_checks(spark, folder):
    ev = events(spark, folder)
    return q.union_checks([
        q.aggregate_checks(ev, "events", [
            q.not_null(["event_id", "unit", "day"]), q.non_negative(["amount"]),
            q.allowed_values(["type"], TYPES), q.rule("amount_is_large", F.col("amount") > 499000)]),
        q.unique(ev, "events", ["event_id"], "event_id_is_unique"),
        q.same_keys(ev.select("unit"), units(spark, folder).select("unit"), ["unit"], "events", "units_agree"),
        q.functional_dependency(ev, "events", ["event_id"], ["unit"], "event_has_one_unit"),
        q.subset(ev.select("unit"), units(spark, folder).select("unit"), ["unit"], "events", "units_known")])


@query("quality_report", f"""WITH {E}, n AS (SELECT count(*) FILTER (WHERE amount > 499000) AS big FROM ev),
  s AS (SELECT count(*) AS d FROM (SELECT DISTINCT o_custkey FROM orders) o FULL JOIN customer c ON c_custkey = o_custkey WHERE c_custkey IS NULL OR o_custkey IS NULL)
  SELECT 'events' AS "table", name, CASE WHEN name = 'amount_is_large' AND (SELECT big FROM n) > 0 THEN 'FAIL'
    WHEN name = 'units_agree' AND (SELECT d FROM s) > 0 THEN 'FAIL' ELSE 'PASS' END AS status
  FROM (VALUES ('not_null'), ('non_negative'), ('allowed_values'), ('amount_is_large'), ('event_id_is_unique'), ('units_agree'), ('event_has_one_unit'), ('units_known')) t(name)""")
def quality_report(spark, folder):
    return order_checks(spark, folder).select("table", "name", "status")


@query("quality_status", """WITH big AS (SELECT count(*) AS n FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) > 499000),
  s AS (SELECT count(*) AS d FROM (SELECT DISTINCT o_custkey FROM orders) o FULL JOIN customer c ON c_custkey = o_custkey WHERE c_custkey IS NULL OR o_custkey IS NULL),
  f AS (SELECT CAST(((SELECT n FROM big) > 0) AS BIGINT) + CAST(((SELECT d FROM s) > 0) AS BIGINT) AS failed)
  SELECT CASE WHEN failed > 0 THEN 'FAIL' ELSE 'PASS' END AS status, CAST(8 AS BIGINT) AS checks, failed FROM f""")
def quality_status(spark, folder):
    return q.overall_status(order_checks(spark, folder))


# Releases: the orders before the last year are the previous release; the current one holds all.

def _releases(spark, folder):
    ev = events(spark, folder)
    last = ev.agg(F.max("year")).scalar()
    return ev.withColumn("last", last).filter(F.col("year") < F.col("last")).drop("last"), ev


_OLD = "old AS (SELECT * FROM ev WHERE year < (SELECT max(year) FROM ev))"


@query("release_impact", f"""WITH {E}, {_OLD} SELECT (SELECT count(*) FROM ev) - (SELECT count(*) FROM old) AS event_ids_added,
  CAST(0 AS BIGINT) AS event_ids_removed, (SELECT count(DISTINCT unit) FROM ev) - (SELECT count(DISTINCT unit) FROM old) AS units_added,
  CAST(0 AS BIGINT) AS units_removed, (SELECT count(DISTINCT year) FROM ev) - (SELECT count(DISTINCT year) FROM old) AS years_added, CAST(0 AS BIGINT) AS years_removed""")
def release_impact(spark, folder):
    old, new = _releases(spark, folder)
    labels = {"event_ids": "event_id", "units": "unit", "years": "year"}
    return release.release_impact({k: (old, c) for k, c in labels.items()},
                                  {k: (new, c) for k, c in labels.items()})


_PREV = """prev AS (SELECT l_suppkey AS unit, CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS area,
   sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS urban FROM lineitem WHERE year(l_shipdate) < (SELECT max(year(l_shipdate)) FROM lineitem) GROUP BY 1, 2),
  cur AS (SELECT l_suppkey AS unit, CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS area,
   sum(l_quantity) FILTER (WHERE l_returnflag IN ('R', 'A')) AS urban FROM lineitem GROUP BY 1, 2)"""


@query("common_period_diff", f"""WITH {_PREV}, y AS (SELECT least((SELECT max(year) FROM prev), (SELECT max(year) FROM cur)) AS year)
  SELECT y.year, count(*) AS units_compared, round(avg(abs(c.area - p.area)), 6) AS area_mean_abs_diff, max(abs(c.area - p.area)) AS area_max_abs_diff,
    round(avg(abs(c.urban - p.urban)), 6) AS urban_mean_abs_diff, max(abs(c.urban - p.urban)) AS urban_max_abs_diff
  FROM cur c JOIN prev p USING (unit) CROSS JOIN y WHERE c.year = y.year AND p.year = y.year GROUP BY y.year""")
def common_period_diff(spark, folder):
    rows = panel(spark, folder)
    last = rows.agg(F.max("year")).scalar()
    area = lambda condition: F.sum(F.when(condition, F.col("area")))
    old = (rows.withColumn("last", last).filter(F.col("year") < F.col("last")).groupBy("unit", "year")
           .agg(area(F.col("biome") == "F").alias("area"), area(F.col("class_id") == "R").alias("urban")))
    new = rows.groupBy("unit", "year").agg(F.sum("area").alias("area"),
                                           area(F.col("class_id").isin("R", "A")).alias("urban"))
    diff = release.common_period_diff(old, new, "unit", "year", ["area", "urban"])
    return diff.withColumns({c: F.round(c, 6) for c in ("area_mean_abs_diff", "urban_mean_abs_diff")})


_PARITY = """a AS (SELECT unit, count(*) AS records, min(year) AS first_year, max(year) AS last_year FROM old GROUP BY unit),
  b AS (SELECT unit, count(*) AS records, min(year) AS first_year, max(year) AS last_year FROM ev GROUP BY unit),
  d AS (SELECT unit, 'records' AS metric, CAST(a.records AS VARCHAR) AS old_value, CAST(b.records AS VARCHAR) AS new_value FROM a JOIN b USING (unit) WHERE a.records IS DISTINCT FROM b.records
   UNION ALL SELECT unit, 'first_year', CAST(a.first_year AS VARCHAR), CAST(b.first_year AS VARCHAR) FROM a JOIN b USING (unit) WHERE a.first_year IS DISTINCT FROM b.first_year
   UNION ALL SELECT unit, 'last_year', CAST(a.last_year AS VARCHAR), CAST(b.last_year AS VARCHAR) FROM a JOIN b USING (unit) WHERE a.last_year IS DISTINCT FROM b.last_year)"""


def _parity(spark, folder):
    metrics = lambda df: df.groupBy("unit").agg(F.count("*").alias("records"), F.min("year").alias("first_year"),
                                                F.max("year").alias("last_year"))
    old, new = _releases(spark, folder)
    return metrics(old), metrics(new), ["records", "first_year", "last_year"]


@query("parity_report", f"WITH {E}, {_OLD}, {_PARITY} SELECT * FROM d")
def parity_report(spark, folder):
    old, new, metrics = _parity(spark, folder)
    return release.parity_report(old, new, "unit", metrics)


@query("parity_summary", f"""WITH {E}, {_OLD}, {_PARITY} SELECT (SELECT count(*) FROM a) AS old_keys, (SELECT count(*) FROM b) AS new_keys,
  (SELECT count(*) FROM a JOIN b USING (unit)) AS common_keys, (SELECT count(*) FROM a ANTI JOIN b USING (unit)) AS old_only,
  (SELECT count(*) FROM b ANTI JOIN a USING (unit)) AS new_only, (SELECT count(DISTINCT unit) FROM d) AS difference_count""")
def parity_summary(spark, folder):
    old, new, metrics = _parity(spark, folder)
    return release.parity_summary(old, new, "unit", metrics)


def _fingerprint_sql(name, *columns):
    cell = lambda c: f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    half = lambda start: f"sum(CAST(CAST('0x' || substr(m, {start}, 15) AS UBIGINT) AS HUGEINT))"
    return f"""SELECT '{name}' AS name, count(*) AS rows, sha256(count(*) || '|' || {half(1)} || '|' || {half(17)}) AS fingerprint
      FROM (SELECT md5({" || ".join(cell(c) for c in columns)}) AS m FROM {name})"""


@query("table_fingerprint", _fingerprint_sql("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
       + " UNION ALL " + _fingerprint_sql("documents", "doc_id", "text", "lang", "source", "n_chars"))
def table_fingerprint(spark, folder):
    """Content hash of two whole tables."""
    tables = [release.table_fingerprint(table(spark, folder, name)).withColumn("name", F.lit(name))
              for name in ("orders", "documents")]
    return tables[0].unionByName(tables[1])


@query("hash_gate", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS rows, CASE WHEN year(o_orderdate) = 1998 THEN 'added'
    WHEN bool_or(year(o_orderdate) = 1995 AND o_orderkey % 7 = 0) THEN 'changed' ELSE 'unchanged' END AS state FROM orders GROUP BY year(o_orderdate)""")
def hash_gate(spark, folder):
    """Which years of all orders moved since a release that lacked 1998 and held other prices in 1995."""
    current = table(spark, folder, "orders").withColumn("year", F.year("o_orderdate"))
    price = F.col("o_totalprice")
    corrected = (F.col("year") == 1995) & (F.col("o_orderkey") % 7 == 0)
    previous = current.filter("year <> 1998").withColumn("o_totalprice", F.when(corrected, price + 1).otherwise(price))
    digests = lambda df: release.partition_digests(df, ["year"])
    return release.moved_partitions(digests(previous), digests(current), ["year"])


@query("latest_successful_run", """SELECT user_id AS source, event_id AS run, CAST(ts AS DATE) AS day FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type <> 'error') WHERE k = 1""")
def latest_successful_run(spark, folder):
    """Events read as run records: the newest run of each source that did not fail."""
    runs = table(spark, folder, "events").filter(F.col("event_type") != "error").select(
        F.col("user_id").alias("source"), F.col("event_id").alias("run"), "ts")
    return keys.latest_per_key(runs, ["source"], ["ts", "run"]).select(
        "source", "run", F.to_date("ts").alias("day"))
