import random

import pytest

from llm_cases import CLASHING, awkward, proposals, words_of
from panelspark.llm.decontaminate import find_evaluation_items


def brute(rows, items, window=13):
    windows = {}
    for item, text in items:
        words = words_of(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i:i + n]), set()).add(item)
    sizes, out = {len(w) for w in windows}, []
    for i, text in rows:
        words = words_of(text)
        hit, names = set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                found = windows.get(tuple(words[k:k + n]))
                if found:
                    hit |= set(range(k, k + n))
                    names |= found
        out.append((i, len(words), len(hit), sorted(str(x) for x in names if x is not None), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_words", [200_000, 20])
@pytest.mark.parametrize("short", [False, True])
def test_against_brute_force(spark, short, block_words):
    rng = random.Random(4)
    rows = awkward()
    texts = [t for _, t in rows if t and 20 < len(t) < 4000]
    items = [(i, None) for i in (1, 2)] + [(3, ""), (4, "?!")]
    for i in range(12):
        words = rng.choice(texts).split()
        at = rng.randrange(max(1, len(words) - 20))
        items.append((10 + i, " ".join(words[at:at + rng.randint(13, 25)])))
    items += [(10, items[-1][1]), (None, items[-2][1]), (90, "palavra " * 15)]
    if short:
        items += [(50, "contenção"), (51, "São Paulo"), (52, "são paulo"), (53, "obra de")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = find_evaluation_items(proposals(spark, rows, [c for c in CLASHING]), table, block_words=block_words).collect()
    assert sorted(((r.ID_PROPOSTA, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got), key=repr) == brute(rows, items)
    for r in got:
        assert all(a["last"] < b["first"] for a, b in zip(r.spans, r.spans[1:]))
        assert sum(s["last"] - s["first"] for s in r.spans) == r.n_hit


def test_items_that_share_beginnings_and_ends(spark):
    items = [(1, "a b a b a b c"), (2, "b a b c"), (3, "a b"), (4, "c a b a b")]
    rows = [(i, t) for i, t in enumerate(["a b a b a b c", "x b a b c a b", "c a b a b a b c", "b a", "a a b b"])]
    got = find_evaluation_items(proposals(spark, rows), spark.createDataFrame(items, "item_id long, text string"), window=4).collect()
    assert sorted((r.ID_PROPOSTA, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got) == brute(rows, items, 4)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_evaluation_items(proposals(spark, []), none).collect() == []
    row = find_evaluation_items(proposals(spark, [(1, "uma obra")]), none).first()
    assert (row.n_words, row.n_hit, row["items"], row.contaminated) == (2, 0, [], False)
