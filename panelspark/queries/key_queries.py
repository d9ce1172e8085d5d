"""Key comparisons, dedup, survey states and section states."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import states as st
from panelspark.functions.numbers import serial_to_date
from panelspark.operators import conform, keys
from panelspark.queries.registry import E, U, events, query, table, units


@query("left_match_flag", """SELECT d.doc_id, d.source, l.doc_id IS NOT NULL AS is_match FROM documents d LEFT JOIN labels l USING (doc_id)""")
def left_match_flag(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return keys.left_with_match(docs, table(spark, folder, "labels"), "doc_id", "doc_id")


@query("key_comparison", """SELECT count(*) FILTER (WHERE a) AS left_keys, count(*) FILTER (WHERE b) AS right_keys,
  count(*) FILTER (WHERE a AND b) AS matched_keys, count(*) FILTER (WHERE a AND NOT b) AS left_only,
  count(*) FILTER (WHERE b AND NOT a) AS right_only
  FROM (SELECT user_id IS NOT NULL AS a, conv_id IS NOT NULL AS b FROM (SELECT DISTINCT user_id FROM events) e
        FULL JOIN (SELECT DISTINCT conv_id FROM conversations) c ON e.user_id = c.conv_id)""")
def key_comparison(spark, folder):
    left = table(spark, folder, "events").select(F.col("user_id").alias("k"))
    right = table(spark, folder, "conversations").select(F.col("conv_id").alias("k"))
    return keys.key_comparison_counts(left, right, ["k"])


@query("anti_both_ways", """SELECT DISTINCT user_id AS k, 'left_only' AS side FROM events WHERE user_id NOT IN (SELECT conv_id FROM conversations)
  UNION ALL SELECT DISTINCT conv_id, 'right_only' FROM conversations WHERE conv_id NOT IN (SELECT user_id FROM events)""")
def anti_both_ways(spark, folder):
    left = table(spark, folder, "events").select(F.col("user_id").alias("k"))
    right = table(spark, folder, "conversations").select(F.col("conv_id").alias("k"))
    return (keys.only_in_left(left, right, ["k"]).withColumn("side", F.lit("left_only"))
            .unionByName(keys.only_in_left(right, left, ["k"]).withColumn("side", F.lit("right_only"))))


@query("key_intersection", "SELECT DISTINCT user_id AS k FROM events WHERE user_id IN (SELECT conv_id FROM conversations)")
def key_intersection(spark, folder):
    return keys.in_both(table(spark, folder, "events").select(F.col("user_id").alias("k")),
                        table(spark, folder, "conversations").select(F.col("conv_id").alias("k")), ["k"])


@query("unused_dim_members", """SELECT n_nationkey AS nation, n_name AS name FROM nation
  WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def unused_dim_members(spark, folder):
    dim = table(spark, folder, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    fact = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"))
    return keys.unused_members(dim, fact, "nation")


@query("subset_test", """SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM documents)) = 0 AS labels_in_documents,
  (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels)) = 0 AS documents_in_labels""")
def subset_test(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    outside = lambda a, b: (keys.only_in_left(a, b, ["doc_id"]).agg(F.count("*")).scalar() == 0)
    return spark.range(1).select(outside(labels, docs).alias("labels_in_documents"),
                                 outside(docs, labels).alias("documents_in_labels"))


@query("dup_keys", f"WITH {E} SELECT unit, day, count(*) AS n FROM ev GROUP BY unit, day HAVING count(*) > 1")
def dup_keys(spark, folder):
    return keys.duplicate_keys(events(spark, folder), ["unit", "day"])


@query("fd_violations", f"""WITH {E} SELECT unit, count(*) AS values FROM (SELECT DISTINCT unit, year, status FROM ev)
  GROUP BY unit HAVING count(*) <> 1""")
def fd_violations(spark, folder):
    return keys.dependency_violations(events(spark, folder), ["unit"], ["year", "status"])


@query("first_seen_dedup", """SELECT user_id, event_type, arg_min(event_id, event_id) AS event_id, arg_min(value, event_id) AS value
  FROM events GROUP BY user_id, event_type""")
def first_seen_dedup(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_type", "event_id", "value")
    return keys.first_seen(rows, ["user_id", "event_type"], "event_id")


@query("last_wins_dedup", """SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value
  FROM events GROUP BY user_id, event_type""")
def last_wins_dedup(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_type", "event_id", "value")
    return keys.last_wins(rows, ["user_id", "event_type"], "event_id")


@query("latest_per_key", """SELECT user_id, day, event_id, event_type FROM (
  SELECT user_id, CAST(ts AS DATE) AS day, event_id, event_type,
    row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def latest_per_key(spark, folder):
    rows = table(spark, folder, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "event_type")
    return keys.latest_per_key(rows, ["user_id"], ["day", "event_id"])


@query("union_of_lists", """SELECT user_id, string_agg(DISTINCT label, '|' ORDER BY label) AS labels FROM (
  SELECT user_id, event_type AS label FROM events UNION ALL
  SELECT user_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END FROM events) GROUP BY user_id""")
def union_of_lists(spark, folder):
    size = F.when(F.col("value") > 50, "high").otherwise("low")
    rows = table(spark, folder, "events").select("user_id", F.array("event_type", size).alias("labels"))
    return keys.union_of_lists(rows, ["user_id"], "labels").withColumn("labels", F.array_join("labels", "|"))


@query("sorted_distinct_lists", """SELECT o_custkey AS unit, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS types,
  string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY o_custkey""")
def sorted_distinct_lists(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderpriority").alias("types"),
                                                 F.col("o_orderstatus").alias("statuses"))
    lists = keys.sorted_distinct(rows, ["unit"], ["types", "statuses"])
    return lists.withColumns({c: F.array_join(c, "|") for c in ("types", "statuses")})


def typed_copies(spark, folder):
    """Orders as text and a workbook-like copy: serial dates, doubles, escapes, some rows changed."""
    orders = table(spark, folder, "orders")
    day = F.to_date("o_orderdate")
    left = orders.select(
        F.col("o_orderkey").alias("id"), F.date_format(day, "d/M/yyyy").alias("day"),
        F.col("o_totalprice").cast("decimal(38,2)").cast("string").alias("amount"),
        F.col("o_custkey").cast("string").alias("count"), F.col("o_orderpriority").alias("label"))
    changed = F.when(F.col("o_totalprice") > 400000, 0.01).otherwise(0.0)
    right = orders.select(
        F.col("o_orderkey").alias("id"),
        (F.datediff(day, F.lit("1899-12-30").cast("date")) + F.lit(0.25)).cast("string").alias("day"),
        (F.col("o_totalprice") + changed).cast("string").alias("amount"),
        F.col("o_custkey").cast("double").cast("string").alias("count"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.col("o_orderpriority"), F.lit("_x000D_")))
        .when(F.col("o_custkey") > 1400, F.lit("other")).otherwise(F.col("o_orderpriority")).alias("label"))
    return left, right


def typed_comparison(spark, folder):
    from panelspark.functions.numbers import lenient, parse_day
    from panelspark.functions.text import clean_workbook_text

    left, right = typed_copies(spark, folder)
    return keys.compare_copies(left, right, "id", {
        "day": (parse_day(F.col("l.day")), serial_to_date(F.col("r.day"))),
        "amount": (lenient(F.col("l.amount"), "decimal(38,2)"),
                   F.round(F.col("r.amount").try_cast("double"), 2).cast("decimal(38,2)")),
        "count": (lenient(F.col("l.count"), "bigint"),
                  F.round(F.col("r.count").try_cast("double"), 0).cast("bigint")),
        "label": (F.coalesce("l.label", F.lit("")), F.coalesce(clean_workbook_text(F.col("r.label")), F.lit("")))})


@query("typed_copy_diff", """SELECT o_orderkey AS id, true AS day_matches, NOT (o_totalprice > 400000) AS amount_matches, true AS count_matches,
  NOT (o_custkey > 1400 AND o_orderstatus <> 'P') AS label_matches,
  NOT (o_totalprice > 400000) AND NOT (o_custkey > 1400 AND o_orderstatus <> 'P') AS all_fields_match, CAST(1 AS BIGINT) AS pairs FROM orders""")
def typed_copy_diff(spark, folder):
    return typed_comparison(spark, folder)


@query("typed_copy_counts", """SELECT count(*) AS compared_rows,
  count(*) FILTER (WHERE o_totalprice > 400000 OR (o_custkey > 1400 AND o_orderstatus <> 'P')) AS differing_rows,
  CAST(0 AS BIGINT) AS day_differences, count(*) FILTER (WHERE o_totalprice > 400000) AS amount_differences, CAST(0 AS BIGINT) AS count_differences,
  count(*) FILTER (WHERE o_custkey > 1400 AND o_orderstatus <> 'P') AS label_differences FROM orders""")
def typed_copy_counts(spark, folder):
    return keys.mismatch_counts(typed_comparison(spark, folder))


# Survey: labels answer two questions for some documents; answers vary in case and accents.

_ANSWERS = """ans AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'declared_yes' WHEN toxic = 1 THEN 'refused' ELSE 'declared_no' END AS a,
  CASE WHEN toxic = 1 THEN 'declared_yes' WHEN quality = 0 THEN 'not_applicable' ELSE 'declared_no' END AS b,
  CASE WHEN quality = 0 AND toxic = 0 THEN 'not_reported' ELSE 'declared_no' END AS c FROM labels)"""


def answers(spark, folder):
    q, t = F.col("quality"), F.col("toxic")
    return table(spark, folder, "labels").select(
        "doc_id",
        F.when(q == 1, " SIM ").when(t == 1, "recusa").otherwise("Não").alias("a"),
        F.when(t == 1, "Sim").when(q == 0, "-").otherwise("NÃO").alias("b"),
        F.when((q == 0) & (t == 0), "Não informou").otherwise("nao").alias("c"))


def states(spark, folder):
    return answers(spark, folder).withColumns({c: st.answer_state(F.col(c)) for c in ("a", "b", "c")})


@query("answer_state", f"WITH {_ANSWERS} SELECT doc_id, a, b, c FROM ans")
def answer_state(spark, folder):
    return states(spark, folder)


_COMBINE = """CASE WHEN 'declared_yes' IN (a, b, c) THEN 'declared_yes'
  WHEN a = 'declared_no' AND b = 'declared_no' AND c = 'declared_no' THEN 'declared_no'
  WHEN 'refused' IN (a, b, c) THEN 'refused' WHEN 'not_reported' IN (a, b, c) THEN 'not_reported'
  WHEN 'unknown' IN (a, b, c) THEN 'unknown' ELSE 'not_applicable' END"""


@query("combine_states", f"""WITH {_ANSWERS} SELECT doc_id, {_COMBINE} AS combined,
  CASE WHEN b = 'declared_yes' THEN 'unknown' ELSE a END AS overridden FROM ans""")
def combine_states(spark, folder):
    return states(spark, folder).select(
        "doc_id", st.combine_states(F.array("a", "b", "c")).alias("combined"),
        st.override_state(F.col("a"), F.col("b")).alias("overridden"))


@query("survey_gold", f"""WITH {_ANSWERS} SELECT d.doc_id, d.lang, s.doc_id IS NOT NULL AS in_source,
  coalesce(a, 'not_in_source') AS a, coalesce(b, 'not_in_source') AS b, coalesce(c, 'not_in_source') AS c,
  2020 AS source_year FROM documents d LEFT JOIN ans s USING (doc_id)""")
def survey_gold(spark, folder):
    survey = states(spark, folder).withColumn("source_year", F.lit(2020))
    return conform.survey_gold(table(spark, folder, "documents"), survey, "doc_id", ["a", "b", "c"],
                               ["lang"], ["source_year"], 2020)


@query("survey_status_counts", f"""WITH {_ANSWERS}, g AS (SELECT unnest([a, b, c]) AS state, unnest(['a', 'b', 'c']) AS question FROM
  (SELECT coalesce(a, 'not_in_source') AS a, coalesce(b, 'not_in_source') AS b, coalesce(c, 'not_in_source') AS c FROM documents LEFT JOIN ans USING (doc_id)))
  SELECT question, state, count(*) AS n FROM g GROUP BY ALL""")
def survey_status_counts(spark, folder):
    long = survey_gold(spark, folder).unpivot(["doc_id"], ["a", "b", "c"], "question", "state")
    return long.groupBy("question", "state").agg(F.count("*").alias("n"))


@query("section_state", f"""WITH {U}, {E}, h AS (SELECT unit, count(*) FILTER (WHERE flagged AND year = (SELECT max(year) FROM ev)) AS n FROM ev GROUP BY unit)
  SELECT u.unit, CASE WHEN coalesce(h.n, 0) > 0 THEN 'record' ELSE 'no_record' END AS events_state,
    CASE WHEN s.s_suppkey IS NULL THEN 'no_coverage' ELSE 'record' END AS panel_state,
    CASE WHEN l.doc_id IS NULL THEN 'not_in_legacy_universe' WHEN l.v IS NULL THEN 'not_published' ELSE 'record' END AS census_state,
    CASE WHEN l.doc_id IS NULL THEN 'not_in_legacy_universe' WHEN l.w IS NULL THEN 'no_record' ELSE 'record' END AS transfer_state,
    CASE WHEN l.doc_id IS NOT NULL THEN 'record' ELSE 'not_in_source' END AS survey_state
  FROM units u LEFT JOIN h USING (unit) LEFT JOIN supplier s ON s.s_suppkey = u.unit
  LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN quality END AS v, CASE WHEN toxic = 1 THEN toxic END AS w FROM labels) l ON l.doc_id = u.unit""")
def section_state(spark, folder):
    """Why a section of a unit is empty: no event, no coverage, unpublished, outside the universe."""
    ev = events(spark, folder)
    last = ev.agg(F.max("year")).scalar()
    counts = ev.withColumn("last", last).groupBy("unit").agg(
        F.count_if(F.col("flagged") & (F.col("year") == F.col("last"))).alias("n"))
    covered = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("unit"), F.lit(1).alias("panel_rows"))
    legacy = table(spark, folder, "labels").select(
        F.col("doc_id").alias("unit"), F.lit(True).alias("known"),
        F.when(F.col("quality") == 1, 1).alias("v"), F.when(F.col("toxic") == 1, 1).alias("w"))
    joined = (units(spark, folder).select("unit").join(counts, "unit", "left")
              .join(covered, "unit", "left").join(legacy, "unit", "left"))
    return joined.select(
        "unit", st.events_state(F.coalesce("n", F.lit(0))).alias("events_state"),
        st.coverage_state(F.col("panel_rows")).alias("panel_state"),
        st.published_state(F.col("known"), F.col("v")).alias("census_state"),
        st.optional_state(F.col("known"), F.col("w")).alias("transfer_state"),
        st.source_state(F.col("known")).alias("survey_state"))
