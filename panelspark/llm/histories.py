"""Event histories that begin alike: a prefix trie of them, with counts and savings per node."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.llm.common import stage_table, text_or_empty
from panelspark.llm.forest import TASK_NODES, forest_totals

WORD = r"[^\x20\x09-\x0D]+"


def _digest(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat_ws(":", *parts), 256)), 1, 16)


def history_steps(events: DataFrame, unit: str = "codigo_ibge", order: str = "event_date", kind: str = "cobrade_code",
                  text: str = "human_damage_description") -> DataFrame:
    """The events of each unit as numbered steps: ``unit``, ``place`` (from 1), ``step`` (a digest of kind and
    text), ``words`` of the text.

    Events are ordered by ``order``, nulls first, ties by kind and then by digest, so the rows of a repeated
    event are steps of their own.  A null kind or text is empty; events of a null unit take no part.  Texts are
    read whole and go no further than the scan, however long; other columns are ignored.
    """
    kinds, texts = text_or_empty(F.col(kind).cast("string")), text_or_empty(text)
    narrow = events.filter(F.col(unit).isNotNull()).select(
        F.col(unit).alias("unit"), F.col(order).alias("held_order"), kinds.alias("held_kind"),
        _digest(F.length(kinds).cast("string"), kinds, texts).alias("step"),
        F.regexp_count(texts, F.lit(WORD)).cast("long").alias("words"))
    turn = Window.partitionBy("unit").orderBy(F.asc_nulls_first("held_order"), "held_kind", "step")
    return narrow.select("unit", F.row_number().over(turn).cast("long").alias("place"), "step", "words")


def _listed_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined units of every node, read as a stream of sorted rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            nodes, digests = [], []
            for here, unit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if here != node:
                    if node is not None:
                        nodes.append(node)
                        digests.append(state.hexdigest())
                    node, state = here, hashlib.sha256(str(unit).encode())
                else:
                    state.update(f",{unit}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends"])

    return ends.repartition("node").sortWithinPartitions("node", "unit").mapInArrow(run, "node binary, ends string")


def history_trie(steps: DataFrame, units: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """The prefix trie of all units' histories, one row per distinct sequence of first steps.

    ``steps`` has one row per ``unit`` and ``place`` (1, 2, ... without gaps), as ``history_steps`` gives
    them; ``units`` lists every ``unit``, those without steps too (a null unit is none, a repeated one counts once).  Two sequences
    are the same if their steps have the same digests.  The root is the empty sequence; a unit is a
    member of every node that its history begins with.  No units, no rows.

    Returns ``unit`` (the smallest member), ``depth``, ``parent_unit`` (the parent's smallest member, null at the
    root), ``n_units`` (members), ``n_children``, ``n_leaves`` (childless nodes in the subtree, the node
    included), ``saved_words`` (over the subtree: (members - 1) times the words of a node's last step, what
    a shared prefix saves), ``ends`` (SHA-256 of the members that end here, ascending and comma-joined).

    Nodes are known by sums of step digests, so a history needs no list of its own.  Members are counted
    with partial aggregation; a node that a third of all units share is one row per task.  Totals of
    subtrees come from a centroid decomposition of the parent edges (``forest.forest_totals``).  The units that
    end in one node are hashed one after the other in sorted order by one task, which holds none of them.
    """
    turn = Window.partitionBy("unit").orderBy("place")
    part = F.sha2(F.concat(F.col("step"), F.encode(F.concat(F.lit(":"), F.col("place")), "utf-8")), 256)
    own = {n: F.conv(F.substring(part, at, 15), 16, 10).cast("decimal(38,0)") for n, at in (("lo", 1), ("hi", 16))}
    running = (steps.select("unit", "place", "words", *[c.alias(n) for n, c in own.items()])
               .select("unit", "place", "words", "lo", "hi", F.sum("lo").over(turn).alias("to_lo"), F.sum("hi").over(turn).alias("to_hi"),
                       F.lead("place").over(turn).isNull().alias("ends"), F.count("*").over(Window.partitionBy("unit")).alias("length")))

    def key(depth: Column, lo: Column, hi: Column) -> Column:
        return _digest(*(c.cast("string") for c in (depth, lo, hi)))

    place, zero = F.col("place"), F.lit(0).cast("decimal(38,0)")
    below = running.select(
        F.col("unit").alias("walker"), place.alias("depth"), key(place, F.col("to_lo"), F.col("to_hi")).alias("node"),
        F.when(place == 1, key(F.lit(0), zero, zero)).otherwise(
            key(place - 1, F.col("to_lo") - F.col("lo"), F.col("to_hi") - F.col("hi"))).alias("parent"), "words", "ends", "length")
    everyone = units.filter(F.col("unit").isNotNull()).select(F.col("unit").alias("walker")).distinct()
    lengths = steps.groupBy(F.col("unit").alias("walker")).agg(F.count("*").alias("length"))
    roots = everyone.join(lengths, "walker", "left").select(
        "walker", F.lit(0).cast("long").alias("depth"), key(F.lit(0), zero, zero).alias("node"), F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("long").alias("words"), F.col("length").isNull().alias("ends"), F.coalesce("length", F.lit(0)).alias("length"))
    paths = stage_table(below.unionByName(roots))
    nodes = paths.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("walker").alias("walker"), F.max("words").alias("words"),
        F.count("*").alias("n_units"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"))
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = stage_table(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                        .withColumn("n_leaves", (F.col("n_children") == 0).cast("long"))
                        .withColumn("saved_words", (F.col("n_units") - 1) * F.col("words")))
    totals = forest_totals(nodes, paths.select("walker", "depth", "node", "parent"), ["n_leaves", "saved_words"], task_nodes)
    ends = _listed_digests(paths.filter("ends").select("node", F.col("walker").alias("unit")))
    named = nodes.select(F.col("node").alias("parent"), F.col("walker").alias("parent_unit"))
    return (nodes.drop("n_leaves", "saved_words").join(totals, "node").join(ends, "node", "left").join(named, "parent", "left")
            .select(F.col("walker").alias("unit"), "depth", "parent_unit", "n_units", "n_children", "n_leaves", "saved_words",
                    F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends")))
