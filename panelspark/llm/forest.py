"""Subtree totals of a forest of parent edges by centroid decomposition.

A component is split at a centroid, a node below which and above which at most half of it is left.
What lies below the centroid inside its component is totalled over the components that the split
leaves there, and the total is added to the nodes on the path from the centroid to the component's
top.  Then the parts are split in the same way.  A node is on at most a logarithmic number of such
paths, however deep the forest is.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.session import cut_lineage

#: Nodes of a component that one task may split to the end.
TASK_NODES = 50_000
ROUNDS = 80


def _tops(parent: np.ndarray) -> np.ndarray:
    """The highest node above each node; ``parent`` of a top is the top itself."""
    while True:
        above = parent[parent]
        if (above == parent).all():
            return parent
        parent = above


def component_totals(parent: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Totals of ``values`` (one row per node) over the subtree of every node; ``parent`` is -1 at tops."""
    n = len(parent)
    total = np.zeros_like(values)
    held = np.arange(n)
    inside = np.where(parent < 0, held, parent)
    size = np.ones(n, np.int64)
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        level = level[parent[level] >= 0]
        np.add.at(size, parent[level], size[level])
    alive = np.ones(n, bool)
    top = _tops(inside.copy())
    while len(held):
        # The smallest subtree that holds at least half of its component.
        whole = np.bincount(top[held], minlength=n)
        large = held[2 * size[held] >= whole[top[held]]]
        large = large[np.lexsort((size[large], top[large]))]
        centroid = large[np.r_[True, np.diff(top[large]) != 0]] if len(large) else large
        above = np.where(inside[centroid] == centroid, -1, inside[centroid])
        alive[centroid] = False
        inside[centroid] = centroid
        held = held[alive[held]]
        cut = held[~alive[inside[held]]]
        under = inside[cut]
        inside[cut] = cut
        top = _tops(inside.copy())
        # Totals of the components that lie directly below each centroid.
        sums = np.zeros_like(values)
        np.add.at(sums, top[held], values[held])
        below = values.copy()
        np.add.at(below, under, sums[cut])
        below, gone = below[centroid], size[centroid]
        total[centroid] += below
        # Every component has one path, so no node is met twice in a step.
        while True:
            on = above >= 0
            above, below, gone = above[on], below[on], gone[on]
            if not len(above):
                break
            total[above] += below
            size[above] -= gone
            above = np.where(inside[above] == above, -1, inside[above])
    return total


def _split(held: DataFrame, paths: DataFrame, values: list[str], task_nodes: int) -> tuple[list, list]:
    """Parts of ``held`` whose components have at most ``task_nodes`` nodes, and what was added along paths."""
    done, added = [], []
    for _ in range(ROUNDS):
        sizes = held.groupBy("component").agg(F.count("*").alias("n"), F.max("weight").alias("all"))
        sizes = cut_lineage(sizes)
        large = sizes.filter(F.col("n") > task_nodes)
        if large.isEmpty():
            done.append(held)
            break
        done.append(held.join(large.select("component"), "component", "left_anti"))
        open_ = held.join(large.select("component", "all"), "component")
        # The lightest node that still carries half of its component.
        heavy = open_.filter(2 * F.col("weight") >= F.col("all"))
        centroid = cut_lineage(heavy.groupBy("component").agg(F.min_by(
            F.struct("node", "walker", "depth", "weight"), F.struct("weight", F.negative("depth"), "node")).alias("c"))
            .select("component", F.col("c.node").alias("at"), F.col("c.walker").alias("along"),
                    F.col("c.depth").alias("deep"), F.col("c.weight").alias("gone")))
        marked = open_.drop("all").join(centroid.select("component", "at", "deep"), "component")
        step = paths.select("walker", (F.col("depth") - 1).alias("deep"), F.col("node").alias("child"), F.col("parent").alias("at"))
        split = cut_lineage(marked.join(step, ["walker", "deep", "at"], "left").withColumn(
            "under", F.col("child").isNotNull() & (F.col("depth") > F.col("deep"))))
        # A component's total below its centroid, for the centroid and its path to the top.
        sums = [F.sum(F.when(F.col("under") | (F.col("node") == F.col("at")), F.col(v)).otherwise(0)).alias(v) for v in values]
        below = cut_lineage(split.groupBy("component").agg(*sums).join(centroid, "component"))
        path = cut_lineage(below.join(paths.select(F.col("walker").alias("along"), "depth", "node"), "along")
                           .filter(F.col("depth") <= F.col("deep"))
                           .select("component", "node", "gone", *values)
                           .join(split.select("component", "node"), ["component", "node"]))
        added.append(path.select("node", *values))
        lighter = path.select("node", "gone")
        held = cut_lineage(
            split.filter(F.col("node") != F.col("at")).join(lighter, "node", "left")
            .select("node", "parent", "depth", "walker", (F.col("weight") - F.coalesce("gone", F.lit(0))).alias("weight"),
                    F.when(F.col("under"), F.col("child")).otherwise(F.col("component")).alias("component"), *values))
    else:
        raise RuntimeError(f"components did not fall below {task_nodes} nodes in {ROUNDS} rounds")
    return done, added


def forest_totals(nodes: DataFrame, paths: DataFrame, values: Sequence[str], task_nodes: int = TASK_NODES) -> DataFrame:
    """``node`` and the totals of its long ``values`` over its subtree.

    ``nodes``: distinct ``node`` and its ``parent`` (binary, null at a top), ``depth``, a ``walker``
    whose path leads through the node, and ``weight``, the number of path steps in the node's subtree.
    ``paths``: the steps of all walkers (``walker``, ``depth``, ``node``, ``parent``); a step into a node
    is also one into its ancestors.  Nodes and steps with a null id must not occur.

    Components above ``task_nodes`` nodes are split by joins, all of them in one round: the centroid
    by weight is found, its walker's steps are the path to the top, and a node lies below it if its own
    walker's steps lead through it.  Smaller components are dealt to tasks that split them to the end.
    """
    values = list(values)
    total = nodes.count()
    columns = ["node", "parent", "depth", "walker", "weight", *values]
    done, added = [], []
    if total <= task_nodes:
        rest = nodes.select(*columns, F.lit(b"").alias("component"))
    else:
        tops = paths.filter(F.col("depth") == 0).select("walker", F.col("node").alias("component"))
        held = cut_lineage(nodes.select(*columns).join(tops, "walker"))
        done, added = _split(held, paths, values, task_nodes)
        rest = done[0]
        for part in done[1:]:
            rest = rest.unionByName(part)

    def solve(table: pa.Table) -> pa.Table:
        keys = np.array(table.column("node").to_pylist(), dtype="S16")
        above = np.array([p or b"" for p in table.column("parent").to_pylist()], dtype="S16")
        components = np.array(table.column("component").to_pylist(), dtype="S16")
        order = np.argsort(keys)
        found = np.minimum(np.searchsorted(keys[order], above), len(keys) - 1)
        at = order[found]
        parent = np.where((keys[at] == above) & (components[at] == components), at, -1)
        given = np.stack([table.column(v).to_numpy() for v in values], axis=1)
        totals = component_totals(parent, table.column("depth").to_numpy(), given)
        return pa.table({"node": table.column("node"), **{v: totals[:, i] for i, v in enumerate(values)}})

    deals = max(1, -(-total // task_nodes))
    schema = "node binary, " + ", ".join(f"`{v}` long" for v in values)
    solved = (rest.withColumn("deal", F.pmod(F.xxhash64("component"), F.lit(deals)))
              .groupBy("deal").applyInArrow(solve, schema))
    for part in added:
        solved = solved.unionByName(part)
    return solved.groupBy("node").agg(*[F.sum(v).alias(v) for v in values])
