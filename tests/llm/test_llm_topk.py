import random

import numpy as np
import pytest

from panelspark.llm.topk import nearest_profiles


def brute(units, queries, k):
    ok = [(i, v) for i, v in units if i is not None and v is not None and None not in v]
    rows = []
    for q, p in queries:
        if q is None or p is None or None in p:
            continue
        scored = sorted((-sum(a * b for a, b in zip(p, v)), i) for i, v in ok if i != q and len(v) == len(p))[:k]
        rows += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(rows)


def run(spark, units, queries, k=5, **more):
    schema = "codigo_ibge long, perfil array<long>"
    make = lambda rows: spark.createDataFrame(rows, schema).selectExpr("*", "1 AS score", "2 AS v", "3 AS g")
    out = nearest_profiles(make(units), make(queries), k=k, **more)
    return sorted((r.query, r["rank"], r.codigo_ibge, r.score) for r in out.collect())


@pytest.mark.parametrize("scale", [3, 300, 10**6, 10**12])
def test_against_brute_force(spark, scale):
    """Small scales make ties; large ones need wider numbers."""
    rng = np.random.default_rng(scale % 97)
    units = [(i, [int(x) for x in rng.integers(-scale, scale + 1, 8) // (1 if scale < 10**12 else 1000)]) for i in range(400)]
    units += [(400 + i, units[3][1]) for i in range(20)]
    queries = [u for u in units if u[0] % 20 == 0]
    assert run(spark, units, queries, cell_units=150, cell_queries=9) == brute(units, queries, 5)


def test_awkward_rows(spark):
    units = [(1, [1, 2]), (2, None), (3, [None, 1]), (None, [9, 9]), (4, []), (5, []), (6, [0, 0]), (7, [-5, -5]), (8, [1, 2, 3])]
    assert run(spark, units, units) == brute(units, units, 5)


def test_fewer_units_than_wanted_and_none(spark):
    units = [(1, [1]), (2, [1]), (3, [2])]
    assert run(spark, units, units[:1]) == [(1, 1, 3, 2), (1, 2, 2, 1)]
    assert run(spark, [], []) == []
    assert run(spark, units, []) == []


def test_lists_that_allow_an_early_stop(spark):
    rng = random.Random(2)
    units = [(i, [rng.randint(0, 3), rng.randint(0, 3)]) for i in range(3000)] + [(5000 + i, [900 + i, 900]) for i in range(6)]
    queries = [(7000, [5, 1]), (7001, [1, -4])]
    assert run(spark, units, queries) == brute(units, queries, 5)
