import random

import numpy as np
import pytest

from llm_cases import CLASHING, awkward, proposals
from panelspark.llm.suffixes import adjacent_equal, repeated_bytes, two_stage_order


def brute(rows):
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        if i is not None:
            for k in range(len(data) - 49):
                first[data[k:k + 50]] = min(first.get(data[k:k + 50], i), i)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - 49 if i is not None else 0):
            if first[data[k:k + 50]] < i:
                gone[k:k + 50] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone)).astype(int)))
        out.append((i, len(data), [(int(a), int(b)) for a, b in edge.reshape(-1, 2)], bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=repr)


def result(df, **more):
    return sorted(((r.ID_PROPOSTA, r.n_bytes, [(s["start"], s["end"]) for s in r.removed], bytes(r.kept))
                   for r in repeated_bytes(df, **more).collect()), key=repr)


@pytest.mark.parametrize("crowded", [20_000, 2])
def test_awkward_texts_against_brute_force(spark, crowded):
    """With crowded = 2 nearly every anchor is dealt by single passages."""
    rows = awkward()
    assert result(proposals(spark, rows, CLASHING), crowded=crowded) == brute(rows)


def test_digit_strings_are_compared_as_numbers(spark):
    text = "Construção de muro de arrimo e drenagem pluvial na rua principal do bairro"
    df = spark.createDataFrame([("10", text), ("9", text), ("x", text)], "ID_PROPOSTA string, OBJETO_PROPOSTA string")
    left = {r.ID_PROPOSTA: len(r.kept) for r in repeated_bytes(df).collect()}
    assert left == {"9": len(text.encode()), "10": 0, "x": len(text.encode())}


def test_empty_table(spark):
    assert result(proposals(spark, [])) == []


def test_orders_and_common_prefixes():
    rng = random.Random(3)
    for trial in range(60):
        signs = rng.choice([b"ab", b"a", bytes(range(97, 123)), bytes(range(256))])
        text = bytes(rng.choice(signs) for _ in range(rng.randint(1, 300))) * (3 if trial % 3 == 0 else 1)
        data = np.frombuffer(text + bytes(50), np.uint8)
        wanted = np.array(sorted(rng.sample(range(len(text)), rng.randint(1, len(text)))))
        order = two_stage_order(data, wanted)
        keys = [data.tobytes()[i:i + 50] for i in order]
        assert sorted(order) == wanted.tolist() and keys == sorted(keys)
        equal = adjacent_equal(np.concatenate([data, data[:0]]), order)
        assert equal.tolist() == [False] + [a == b for a, b in zip(keys, keys[1:])]
