import random

import pytest

from panelspark.llm.common import components


def brute(links):
    root = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            root.setdefault(a, a)
            root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a in root and b in root and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(None, 2)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 100)],
    [(500 - i, 499 - i) for i in range(0, 100, 2)] + [(3, 3), (7, 9), (9, 7)],
    [(random.Random(i).randrange(300), random.Random(i + 1000).randrange(300)) for i in range(250)]])
def test_smallest_reachable_node(spark, links):
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    want = brute(links)
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_text_nodes(spark):
    got = components(spark.createDataFrame([("c", "b"), ("b", "a"), ("z", "y")], "a string, b string")).collect()
    assert {r.node: r.root for r in got} == {"a": "a", "b": "a", "c": "a", "y": "y", "z": "y"}
