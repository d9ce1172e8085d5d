"""The prefix trie of event histories against plain lists, and totals of forests against plain sums."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from panelspark.llm.forest import component_totals
from panelspark.llm.histories import history_steps, history_trie

EVENTS = "codigo_ibge long, event_date long, cobrade_code string, human_damage_description string"


def words(text):
    return len(text.translate({c: " " for c in range(9, 14)}).replace(" ", " ").split(" ")) - \
        text.translate({c: " " for c in range(9, 14)}).split(" ").count("")


def brute(events, units):
    held = defaultdict(list)
    for unit, order, kind, text in events:
        if unit is not None:
            kind, text = kind or "", text or ""
            digest = hashlib.sha256(f"{len(kind)}:{kind}:{text}".encode()).digest()[:16]
            held[unit].append((order is not None, order or 0, kind, digest, text))
    units = {u for u in units if u is not None}
    paths = {u: [(s[2], s[4]) for s in sorted(held[u])] for u in units}
    nodes = defaultdict(list)
    for unit in sorted(units):
        for depth in range(len(paths[unit]) + 1):
            nodes[tuple(paths[unit][:depth])].append(unit)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        ends = ",".join(str(u) for u in members if len(paths[u]) == len(path))
        out.append((members[0], len(path), nodes[path[:-1]][0] if path else None, len(members),
                    sum(p[:-1] == path and len(p) == len(path) + 1 for p in nodes), sum(not any(q[:-1] == p and q for q in nodes) for p in below),
                    sum((len(nodes[p]) - 1) * words(p[-1][1]) for p in below if p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, events, units, **more):
    made = spark.createDataFrame(events, EVENTS).repartition(3).selectExpr("*", "1 AS unit", "2 AS place", "3 AS node", "4 AS step")
    rows = history_trie(history_steps(made), spark.createDataFrame([(u,) for u in units], "unit long"), **more)
    return sorted(map(tuple, rows.select("unit", "depth", "parent_unit", "n_units", "n_children", "n_leaves", "saved_words", "ends").collect()), key=repr)


def shared_histories(seed):
    rng = random.Random(seed)
    stock = [[(rng.choice("ab"), " ".join(rng.choices(["chuva", "ponte", "rua"], k=rng.randint(0, 3)))) for _ in range(rng.randint(1, 6))]
             for _ in range(6)]
    events = []
    for unit in range(60):
        path = rng.choice(stock)[:rng.randint(0, 6)] + [(rng.choice("ab"), rng.choice("xy")) for _ in range(rng.randint(0, 2))]
        events += [(unit, i, *step) for i, step in enumerate(path)]
    return events


AWKWARD = [(1, 1, "a", "x y"), (1, 2, None, None), (2, 1, "a", "x y"), (2, 2, "", ""), (3, None, "a", "x y"), (3, 1, "", ""), (4, 1, "b", "z"),
           (4, 1, "b", "z"), (4, 1, "a", "z"), (None, 1, "a", "x"), (5, 1, "ax", ""), (6, 1, "a", "x"), (-7, 1, "b", "z"), (9, 1, "é", "linha\nlonga\t" * 3000),
           (10, 1, "é", "linha\nlonga\t" * 3000), (11, 2, "1:a", "b"), (12, 2, "1", "a:b")]


@pytest.mark.parametrize("task_nodes", [50_000, 12])
def test_against_plain_lists(spark, task_nodes):
    events = shared_histories(3)
    want = brute(events, range(60))
    assert trie(spark, events, range(60), task_nodes=task_nodes) == want


def test_awkward_histories(spark):
    units = [1, 2, 3, 4, 5, 6, -7, 8, 8, 9, 10, 11, 12, None]
    want = brute(AWKWARD, units)
    assert trie(spark, AWKWARD, units) == want
    assert trie(spark, AWKWARD, units, task_nodes=3) == want


def test_empty_tables(spark):
    assert trie(spark, [], []) == []
    assert trie(spark, [], [4, 2]) == brute([], [4, 2])


def test_a_history_as_long_as_all_others(spark):
    """One unit's chain holds most nodes: it is halved, not walked node by node."""
    events = [(1, i, "a", f"w {i}") for i in range(300)] + [(2, i, "a", f"w {i}") for i in range(150)] + shared_histories(4)
    want = brute(events, range(60))
    assert trie(spark, events, range(60), task_nodes=40) == want


@pytest.mark.parametrize("shape", ["chain", "star", "random", "forest"])
def test_component_totals(shape):
    rng = np.random.default_rng(1)
    n = 700
    parent = {"chain": np.arange(n) - 1, "star": np.r_[-1, np.zeros(n - 1, int)],
              "random": np.r_[-1, [rng.integers(0, i) for i in range(1, n)]],
              "forest": np.array([-1 if i % 50 == 0 else rng.integers(i - i % 50, i) for i in range(n)])}[shape]
    values = rng.integers(-5, 9, (n, 2))
    depth, want = np.zeros(n, int), values.copy()
    for i in range(n):
        depth[i] = 0 if parent[i] < 0 else depth[parent[i]] + 1
    for i in reversed(range(n)):
        if parent[i] >= 0:
            want[parent[i]] += want[i]
    shuffled = rng.permutation(n)
    back = np.argsort(shuffled)
    moved = np.where(parent[shuffled] < 0, -1, back[parent[shuffled]])
    assert (component_totals(moved, depth[shuffled], values[shuffled]) == want[shuffled]).all()
