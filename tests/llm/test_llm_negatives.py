"""Hard negatives against every pair of a small table."""

import numpy as np
import pytest

from panelspark.llm.negatives import hard_negatives

SCHEMA = "codigo_ibge long, codigo_regiao_imediata long, perfil array<long>"


def brute(units, anchors, positives=5, negatives=5, least=80):
    def usable(rows):
        return [r for r in rows if None not in r and None not in r[2]]

    out = []
    for id, group, profile in {(i, g, tuple(v)) for i, g, v in usable(anchors)}:
        scored = sorted((-sum(a * b for a, b in zip(profile, v)), i, g) for i, g, v in usable(units)
                        if i != id and len(v) == len(profile))
        for s, positive, _ in [x for x in scored if x[2] == group][:positives]:
            near = [x for x in scored if x[2] != group and least * -s <= 100 * -x[0] <= 100 * -s]
            out += [(id, positive, rank, x[1], -s, -x[0]) for rank, x in enumerate(near[:negatives], 1)]
    return sorted(out)


def run(spark, units, anchors, **more):
    def make(rows):
        return spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 AS score", "2 AS v", "3 AS g", "4 AS tag", "5 AS `group`")

    return sorted(map(tuple, hard_negatives(make(units), make(anchors), **more).collect()))


@pytest.mark.parametrize("scale", [2, 40, 10**6])
def test_against_brute_force(spark, scale):
    """Small scales make ties within and across groups."""
    rng = np.random.default_rng(scale)
    units = [(i, int(rng.integers(0, 4)), [int(x) for x in rng.integers(-scale, 2 * scale, 6)]) for i in range(300)]
    units += [(300 + i, i % 2, units[7][2]) for i in range(60)]
    anchors = [u for u in units if u[0] % 15 == 0]
    want = brute(units, anchors)
    assert want and run(spark, units, anchors, cell_units=70, cell_anchors=9) == want
    assert run(spark, units, anchors) == want


def test_awkward_rows(spark):
    units = [(1, 1, [1, 2]), (2, None, [1, 2]), (3, 1, None), (4, 1, [None, 3]), (None, 2, [9, 9]), (5, 2, [1, 2]), (6, 1, [1, 2]),
             (7, 2, []), (8, 1, []), (9, 1, []), (10, 2, [0, 0]), (11, 1, [0, 0]), (12, 1, [-3, -3]), (13, 2, [-3, -3]),
             (14, 3, [5, 5]), (1, 1, [1, 2]), (5, 2, [1, 2]), (5, 2, [2, 2]), (15, 2, [1, 2, 3])]
    assert run(spark, units, units) == brute(units, units)
    assert run(spark, units, units, cell_units=3, cell_anchors=2, positives=2, negatives=1, least=50) == brute(units, units, 2, 1, 50)


def test_empty_tables_and_no_peers(spark):
    units = [(1, 1, [1]), (2, 2, [1]), (3, 3, [2])]
    assert run(spark, units, units) == []
    assert run(spark, [], []) == [] == run(spark, units, [])


def test_a_hot_profile_is_dealt_over_cells(spark):
    """A third of all rows are one row; peers and negatives tie in their hundreds."""
    units = [(i, i % 3, [i % 7, 1]) for i in range(400)] + [(900, 1, [6, 1])] * 200
    anchors = units[:40:10]
    assert run(spark, units, anchors, cell_units=50) == brute(units, anchors)


def test_text_ids(spark):
    make = lambda rows: spark.createDataFrame(rows, "codigo_ibge string, codigo_regiao_imediata string, perfil array<long>")
    units = [(str(i), "ab"[i % 2], [i % 5, 3]) for i in range(40)]
    got = sorted(map(tuple, hard_negatives(make(units), make(units[:3])).collect()))
    assert got == brute(units, units[:3])
