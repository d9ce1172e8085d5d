"""Operators that split large groups, compared with brute force on skewed input."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import benchmark as bm, evidence, keys
from panelspark.operators.keyfilter import key_filter, may_hold
from panelspark.operators.ordering import exact_quantiles, value_counts
from panelspark.operators.shards import pack_shards


def next_fit(rows, cap, fixed):
    parts = {}
    for group in {g for g, _, _ in rows}:
        used, part = None, 0
        for _, key, size in sorted(r for r in rows if r[0] == group):
            if used is None or used + size + 1 > cap:
                used, part = fixed + size, part + 1
            else:
                used += size + 1
            parts[group, key] = part
    return parts


@pytest.mark.parametrize("cap,fixed,block,sizes", [
    (60, 7, 100_000, [5, 9, 20, 37]), (60, 7, 12, [5, 5, 9, 20, 37]), (40, 0, 20, [7]), (500, 3, 15, [1, 2, 90])])
def test_packing_is_greedy_whatever_the_blocks(spark, cap, fixed, block, sizes):
    rng = random.Random(cap + block)
    rows = [(g, f"{i:05d}", rng.choice(sizes)) for g, n in (("hot", 300), ("b", 2), ("c", 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k string, size long")
    got = {(r.g, r.k): r.part for r in pack_shards(df, "g", "k", "size", cap, fixed, block).collect()}
    assert got == next_fit(rows, cap, fixed)


def test_step_functions_compose_like_packing():
    """The block algebra alone, on many random inputs."""
    from panelspark.operators import shards as sh

    rng = random.Random(5)
    for _ in range(200):
        cap, fixed = rng.randint(8, 60), rng.randint(0, 3)
        sizes = [rng.randint(1, min(cap - fixed, 20)) for _ in range(rng.randint(1, 40))]
        cuts = sorted(rng.sample(range(1, len(sizes)), min(len(sizes) - 1, 4))) if len(sizes) > 1 else []
        table, opened, used = None, 0, cap
        for lo, hi in zip([0, *cuts], [*cuts, len(sizes)]):
            block = pd.DataFrame({"group": "g", "block": lo, "key": [f"{i:03d}" for i in range(lo, hi)],
                                  "bytes": sizes[lo:hi], "fixed": fixed, "cap": cap})
            steps = sh._table(sh._block_steps(block))
            table = steps if table is None else sh._compose(table, steps)
        after, shards = sh._apply(table, cap)
        for size in sizes:
            if used + size + 1 > cap:
                used, opened = fixed + size, opened + 1
            else:
                used += size + 1
        assert (after, shards) == (used, opened)


@pytest.mark.parametrize("spread", [{}, {"ranges": 8}, {"ranges": 1}])
def test_ranks_and_quantiles_with_a_hot_group(spark, spread):
    rng = random.Random(9)
    rows = [("hot", rng.choice([0.0, 0.0, rng.random(), rng.randint(1, 9) / 1.0])) for _ in range(900)]
    rows += [("b", 3.0), ("c", 1.0), ("c", 2.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    pdf = pd.DataFrame(rows, columns=["g", "v"]).dropna()
    got = exact_quantiles(df, ["g"], "v", {"p50": 0.5, "p99": 0.99}, **spread).toPandas().set_index("g")
    want = pdf.groupby("g").v.quantile([0.5, 0.99]).unstack()
    for g in ("hot", "b", "c"):
        assert got.loc[g, "p50"] == pytest.approx(want.loc[g, 0.5])
        assert got.loc[g, "p99"] == pytest.approx(want.loc[g, 0.99])
    counts = {(r.g, r.v): (r.n, r.before, r.total) for r in value_counts(df, ["g"], "v", **spread).collect()}
    for (g, v), (n, before, total) in counts.items():
        mine = pdf[pdf.g == g].v
        assert (n, before, total) == ((mine == v).sum(), (mine < v).sum(), len(mine))
    whole = exact_quantiles(df, [], "v", {"p90": 0.9}, **spread).first()
    assert whole.p90 == pytest.approx(pdf.v.quantile(0.9))


def test_peer_benchmark_keeps_missing_undefined_and_zero_apart(spark):
    rows = [("a", "r", "m", 0.0, "included"), ("b", "r", "m", 4.0, "included"), ("c", "r", "m", 8.0, "included"),
            ("d", "r", "m", None, "missing"), ("e", "r", "m", None, "undefined"), ("f", "q", "m", None, "missing")]
    df = spark.createDataFrame(rows, "unit string, region string, metric string, value double, state string")
    got = {r.unit: r for r in bm.peer_benchmark(df, "unit", "region").collect()}
    assert (got["c"].mean, got["c"].median) == (4.0, 4.0)
    assert got["c"].pct_strictly_lower == pytest.approx(200 / 3) and got["a"].pct_strictly_lower == 0
    assert (got["d"].included, got["d"].missing, got["d"].undefined, got["d"].group_size) == (3, 1, 1, 5)
    assert got["d"].pct_strictly_lower is None and got["e"].pct_strictly_lower is None
    assert got["f"].mean is None and got["f"].median is None and got["f"].included == 0


def test_mentions_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["sao", "joao", "rio", "casa", "mar", "lua"]
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 60)))) for i in range(120)]
    phrases = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 6)))) for i in range(40)]
    phrases.append((99, "o rio ca"))  # begins and ends inside words
    texts.append((999, "Sao RIO casa"))
    phrases.append((100, phrases[0][1]))  # the same phrase twice
    t = spark.createDataFrame(texts, "t int, text string")
    p = spark.createDataFrame(phrases, "p int, phrase string")
    for probe in (1, 2, 8):
        got = {(r.t, r.p) for r in evidence.mention_join(t, "t", "text", p, "p", "phrase", probe).collect()}
        assert got == {(i, j) for i, text in texts for j, phrase in phrases if phrase in text.lower()}


def test_mentions_move_windows_not_texts(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(5000))
    spark.createDataFrame([(1, f"{long} Obras em São Paulo, no Acre {long}")], "t int, text string").write.parquet(str(tmp_path / "t"))
    p = spark.createDataFrame([("a", "obras em sao paulo"), ("b", "acre"), ("c", "w4998 w4999 obras")], "p string, phrase string")
    df = evidence.mention_join(spark.read.parquet(str(tmp_path / "t")), "t", "text", p, "p", "phrase")
    assert {r.p for r in df.collect()} == {"a", "b", "c"}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1  # texts are read once
    hits = evidence.probe_hits(F.split(F.lit(f"{long} obras em sao paulo {long}"), " "),
                               evidence.phrase_probes(p.selectExpr("phrase AS __phrase"), 8, 6).persist())
    windows = spark.range(1).select(F.explode(hits).alias("h")).select("h.__window").collect()
    assert windows and max(len(w[0].split(" ")) for w in windows) <= 2 * 4 + 1


def test_key_filter_passes_its_keys_and_few_others(spark):
    keys_ = spark.range(-5000, 5000, 2).select(F.xxhash64("id").alias("k")).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    bits = key_filter(keys_, "k")
    held = spark.range(-5000, 5000).select("id", may_hold(bits, F.xxhash64("id")).alias("held")).collect()
    assert all(r.held for r in held if r.id % 2 == 0)
    assert sum(r.held for r in held if r.id % 2) < 100
    empty = key_filter(keys_.limit(0), "k")
    assert spark.range(100).filter(may_hold(empty, F.col("id"))).count() == 0


def test_dedup_picks_by_arrival(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("a", 2, None), ("b", 5, "z")], "k string, seq int, v string")
    assert {(r.k, r.v) for r in keys.first_seen(df, ["k"], "seq").collect()} == {("a", "y"), ("b", "z")}
    assert {(r.k, r.v) for r in keys.last_wins(df, ["k"], "seq").collect()} == {("a", "x"), ("b", "z")}


def test_struct_dependency_counts_null_as_a_value(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, None), (2, None), (3, "b")], "k int, v string")
    assert [r.k for r in keys.dependency_violations(df, ["k"], ["v"]).collect()] == [1]


def test_counter_entries_order(spark):
    df = spark.createDataFrame([("u", "b"), ("u", "a"), ("u", "c"), ("u", "c"), ("u", None)], "u string, t string")
    entries = keys.counter_entries(df, ["u"], "t", "types").first().types
    assert [(e.label, e.n) for e in entries] == [("c", 2), ("a", 1), ("b", 1)]


def test_copies_with_a_hot_key_do_not_multiply(spark):
    left = spark.createDataFrame([("hot", "1")] * 500 + [("hot", "2"), ("b", "3")], "k string, v string")
    right = spark.createDataFrame([("hot", "1.0")] * 400 + [("b", "4.0")], "k string, v string")
    compared = keys.compare_copies(left, right, "k", {
        "v": (F.col("l.v").cast("double"), F.col("r.v").cast("double"))})
    assert compared.count() == 3
    row = keys.mismatch_counts(compared).first()
    assert (row.compared_rows, row.differing_rows, row.v_differences) == (501 * 400 + 1, 401, 401)


def test_phrases_of_one_and_two_words_are_answered(spark):
    texts = spark.createDataFrame([(1, "Obras em São Paulo e no Acre"), (2, "massacre na rua"), (3, "são paulinho"),
                                   (4, "paulo são"), (5, "Rio de Janeiro, capital"), (6, None)], "id int, t string")
    phrases = spark.createDataFrame([("a", "São Paulo"), ("b", "Acre"), ("c", "rio de janeiro"), ("d", "e"), ("e", ""), ("f", "ão paul")],
                                    "p string, name string")
    got = {(r.id, r.p) for r in evidence.mention_join(texts, "id", "t", phrases, "p", "name").collect()}
    slugs = {1: "obras em sao paulo e no acre", 2: "massacre na rua", 3: "sao paulinho", 4: "paulo sao", 5: "rio de janeiro capital"}
    names = {"a": "sao paulo", "b": "acre", "c": "rio de janeiro", "d": "e", "f": "ao paul"}
    assert got == {(i, p) for i, t in slugs.items() for p, n in names.items() if n in t}
