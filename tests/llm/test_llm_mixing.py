import hashlib
import re

import pytest

from llm_cases import awkward
from panelspark.llm.mixing import emit_mix, mix_narratives

SCHEMA = "Protocolo_S2iD long, regiao string, DH_Descricao string, size long, target string"


def shares(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    """Shares by weight, the excess over the cap shared again until none is above."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    target, free, left = {n: 0.0 for n in names}, set(names), share * sum(sizes.values())
    while free and left > 1e-9:
        total = sum(weight[n] for n in free)
        for n in free:
            target[n] += left * weight[n] / total
        left = 0.0
        for n in list(free):
            if target[n] >= repeats * sizes[n]:
                left += target[n] - repeats * sizes[n]
                target[n] = float(repeats * sizes[n])
                free.discard(n)
    return target


def coin(i):
    return int(hashlib.md5(f"mix-1|{'null' if i is None else i}".encode()).hexdigest()[:12], 16) / 16 ** 12


def rows():
    sources = ["Sul", "Norte", "Nordeste", "", None, "Ágil", "sul", "\U0001F30A"]
    return [(i, sources[k % 8 if k % 3 else 0], t, 1, "x") for k, (i, t) in enumerate(awkward())]


def test_against_the_repeated_sharing(spark):
    data = rows()
    words = [len(re.findall("[^\x20\x09-\x0D]+", t or "")) for _, _, t, *_ in data]
    sizes = {}
    for (_, s, *_), n in zip(data, words):
        sizes[s] = sizes.get(s, 0) + n
    target = shares(sizes)
    got = mix_narratives(spark.createDataFrame(data, SCHEMA)).collect()
    want = []
    for (i, s, *_), n in zip(data, words):
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        copies = int(rate) + (coin(i) < rate - int(rate))
        want.append((i, n, sizes[s], round(target[s], 6), copies, n * copies))
    assert sorted(((r.Protocolo_S2iD, r.size, r.source_size, round(r.target, 6), r["copies"], r.taken) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.taken <= 2 * r.size for r in got)


def test_emitted_rows_are_the_copies(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    planned = sum(r["copies"] for r in mix_narratives(df).collect())
    emitted = emit_mix(df).collect()
    assert len(emitted) == planned and {r["copy"] for r in emitted} <= {1, 2}


@pytest.mark.parametrize("data", [[], [(1, "a", None, 1, "x"), (2, None, "", 1, "x")]])
def test_nothing_to_take(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    assert [r.taken for r in mix_narratives(df).collect()] == [0] * len(data)
    assert emit_mix(df).collect() == []


def test_no_python_runs(spark):
    plan = mix_narratives(spark.createDataFrame(rows(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
