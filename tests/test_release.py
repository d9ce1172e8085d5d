from pyspark.sql import functions as F

from panelspark.operators import evidence, release
from panelspark.operators.events import event_rollup, monetary_reference, type_breakdown
from panelspark.quality import checks as q

import pytest


def test_unchanged_needs_signature_version_and_outputs():
    last = {"input_signature": "s", "pipeline_fingerprint": "p", "output_fingerprints": {"t": "h"}}
    assert release.is_unchanged(last, "s", "p", {"t": "h"})
    assert not release.is_unchanged(last, "other", "p", {"t": "h"})
    assert not release.is_unchanged(last, "s", "other", {"t": "h"})
    assert not release.is_unchanged(last, "s", "p", {"t": "changed"})
    assert not release.is_unchanged(last, "s", "p", {"t": None})
    assert not release.is_unchanged(None, "s", "p", {"t": "h"})


def test_signatures_ignore_the_order_of_sources():
    a = release.input_signature("r", {"x": "1", "y": "2"}, dim="d")
    assert a == release.input_signature("r", {"y": "2", "x": "1"}, dim="d") != release.input_signature("r", {"x": "1"}, dim="d")


def test_table_fingerprint_is_order_free_but_sees_repeats(spark):
    rows = [(1, "a"), (2, "b"), (2, "b")]
    df = spark.createDataFrame(rows, "i int, s string")
    same = spark.createDataFrame(rows[::-1], "i int, s string").repartition(3)
    print_of = lambda d: release.table_fingerprint(d).first().fingerprint
    assert print_of(df) == print_of(same)
    assert print_of(df) != print_of(spark.createDataFrame(rows[:1], "i int, s string"))
    assert print_of(df) != print_of(df.withColumn("i", F.when(F.col("i") == 1, 3).otherwise(F.col("i"))))


def test_schema_changes(spark):
    old = spark.createDataFrame([(1, "a", 1.0)], "a int, b string, c double")
    new = spark.createDataFrame([(1, 2.0, "x")], "a bigint, c double, d string")
    assert release.schema_changes(old, new) == {
        "columns_added": ["d"], "columns_removed": ["b"],
        "types_changed": {"a": {"previous": "int", "current": "bigint"}}}
    assert release.schema_change_rows(old, new).count() == 3


def test_parity_reports_only_differences(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 2, 2), ("x", 1, 1)], "k string, m int, n int")
    new = spark.createDataFrame([("a", 1, None), ("b", 2, 3), ("y", 1, 1)], "k string, m int, n int")
    assert [tuple(r) for r in release.parity_report(old, new, "k", ["m", "n"]).collect()] == [("b", "n", "2", "3")]
    summary = release.parity_summary(old, new, "k", ["m", "n"]).first()
    assert (summary.common_keys, summary.old_only, summary.new_only, summary.difference_count) == (2, 1, 1, 1)


def test_checks_fold_into_one_aggregation(spark):
    df = spark.createDataFrame([("1", -1), ("1", None), ("x", 3)], "k string, v int")
    results = q.aggregate_checks(df, "t", [q.not_null(["v"]), q.non_negative(["v"]), q.matches({"k": "[0-9]"})])
    plan = results._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
    rows = {r.name: r for r in results.collect()}
    assert all(rows[n].status == "FAIL" for n in ("not_null", "non_negative", "code_shapes"))
    assert rows["code_shapes"].observed == '{"invalid_k":1}' and rows["not_null"].expected == '{"v":0}'
    both = q.union_checks([results, q.unique(df, "t", ["k"], "k_unique")])
    assert q.overall_status(both).first().failed == 4
    with pytest.raises(q.QualityFailure, match="code_shapes, k_unique, non_negative, not_null"):
        q.gate(both)


def test_stability_and_coverage_checks(spark):
    df = spark.createDataFrame([("a", 1, 100.0), ("a", 2, 100.5), ("b", 1, 10.0), ("b", 2, 20.0)], "u string, y int, x double")
    row = q.stable_over_time(df, "u", "x", 0.1, 1.0, "t", "stable").first()
    assert row.status == "FAIL" and '"over_failure_threshold":1' in row.observed and '"over_warning_threshold":2' in row.observed
    dim = spark.createDataFrame([("a",), ("b",), ("c",)], "u string")
    assert q.coverage(df, dim, "u", 60.0, "t", "c").first().status == "PASS"
    assert q.coverage(df, dim, "u", 99.0, "t", "c").first().status == "FAIL"


def test_monetary_reference_is_required(spark):
    schema = "reference_year short, igp_di_december_index double, correction_factor double"
    df = spark.createDataFrame([(2023, 1.0, 1.0), (2024, 2.0, 1.0), (2025, 3.0, 1.1)], schema)
    assert tuple(monetary_reference(df).first()) == (2024, 2.0)
    with pytest.raises(Exception, match="no monetary reference"):
        monetary_reference(df.filter("reference_year = 2025")).collect()


def test_attribution_edge_cases(spark):
    s = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names[:-1]) + f", {names[-1]} long"
                                                  if names[-1] == "seq" else ", ".join(f"{n} string" for n in names))
    programs = s([("p1", "Prevenção e preparação a desastres", "20ab"), ("p2", "Gestão de riscos e de desastres", "2000tk"),
                  ("p3", "Gestão de riscos e de desastres", "x"), ("p1", "Prevenção, preparação, DESASTRE", "a8865")],
                 ["ID_PROGRAMA", "NOME_PROGRAMA", "ACAO_ORCAMENTARIA"])
    links = s([("p1", "q1"), ("p2", "q1"), ("p3", "q2"), ("p1", "q3"), ("p2", "q4"), ("p1", "")], ["ID_PROGRAMA", "ID_PROPOSTA"])
    proposals = s([("q1", "4202404", "Obra no município de Joinville", "2001", 1), ("q1", "4202404", "Obra no município de Blumenau", "2002", 2),
                   ("q3", "420", "município de Blumenau", "2003", 3), ("q4", "4202404", "BLUMENAU/SC", "", 4),
                   ("q2", "4202404", "município de Blumenau", "2003", 5)],
                  ["ID_PROPOSTA", "COD_MUNIC_IBGE", "OBJETO_PROPOSTA", "ANO_PROP", "seq"])
    agreements = s([("q1", "n1", "2010", "ok", "1.000,50", 1), ("q4", "n2", "", "zero", "x", 2), ("q1", "n1", "2020", "again", "1", 3),
                    ("q1", "n3", "2005", "a", "2,00", 4), ("q4", "n4", "2010", "tie", "3,00", 5), ("q2", "n5", "2024", "z", "1", 6),
                    ("q1", "", "2024", "z", "1", 7)],
                   ["ID_PROPOSTA", "NR_CONVENIO", "ANO", "SIT_CONVENIO", "VL_GLOBAL_CONV", "seq"])
    units = s([("4202404", "Blumenau", "SC")], ["code", "name", "uf"])
    rows = evidence.attribute_transfers(programs, links, proposals, agreements, units).collect()
    assert len(rows) == 1
    row = rows[0]
    # 2010, then an unknown year that restarts the minimum, then 2005 and 2010.
    assert (row.agreements, row.first_year, row.last_year) == (4, 2005, 2010)
    assert row.actions == ["00TK", "8865", "prevenção/preparação"]
    assert (row.latest.number, row.latest.status, row.latest.globalValue) == ("n4", "tie", 3.0)


def test_rollup_counters(spark):
    df = spark.createDataFrame([("u", 2001, "Seca", "Reconhecido", 1, 2), ("u", None, "Seca", "x", 3, 4), ("u", 2000, "Chuva", "x", 0, 0)],
                               "u string, y int, t string, s string, a int, b int")
    row = event_rollup(df, "u", "y", "t", F.col("s") == "Reconhecido", {"displaced": F.col("a") + F.col("b")}).first()
    assert (row.records, row.recognized, row.first_year, row.last_year, row.displaced) == (3, 1, 2000, 2001, 10)
    assert [(e.label, e.n) for e in row.types] == [("Seca", 2), ("Chuva", 1)] and [e.label for e in row.years] == [2000, 2001]


def test_type_share_is_zero_without_events(spark):
    dim = spark.createDataFrame([("a",), ("b",)], "u string")
    by_type = spark.createDataFrame([("a", 1, "2000-01-01", "2001-01-01", 3, None)], "u string, t int, first_event_date string, latest_event_date string, event_count long, deaths long")
    catalogue = spark.createDataFrame([(1, "x"), (2, "y")], "t int, name string")
    rows = {(r.u, r.t): r for r in type_breakdown(dim, by_type, "u", "t", catalogue, ["event_count", "deaths"]).collect()}
    assert len(rows) == 4 and rows["a", 1].event_pct == 100 and rows["a", 1].deaths == 0 and rows["b", 2].event_pct == 0


def test_partition_digests_tell_what_moved(spark):
    from panelspark.operators.release import moved_partitions, partition_digests, table_fingerprint

    schema = "p int, t string, m map<string,int>, b binary, l array<string>"
    old = [(1, "a", {"x": 1, "y": 2}, b"q", ["a", None]), (1, None, None, None, None), (2, "ab", {}, b"", []), (3, "c", None, None, None)]
    new = [(1, None, None, None, None), (1, "a", {"y": 2, "x": 1}, b"q", ["a", None]), (2, "ab", {}, None, []), (4, "c", None, None, None)]
    left, right = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    moved = moved_partitions(partition_digests(left, ["p"]), partition_digests(right, ["p"]), ["p"])
    assert {r.p: (r.state, r.rows) for r in moved.collect()} == {
        1: ("unchanged", 2), 2: ("changed", 1), 3: ("removed", 1), 4: ("added", 1)}
    # Neither a value that moves to the next column nor a pair of equal rows goes unseen.
    pair = lambda *rows: table_fingerprint(spark.createDataFrame(list(rows), "a string, b string")).first().fingerprint
    assert len({pair(("ab", "c")), pair(("a", "bc")), pair(("ab", "c"), ("ab", "c")), pair(("ab", None)), pair(("ab", "-"))}) == 5
    assert table_fingerprint(left.limit(0)).first().rows == 0
