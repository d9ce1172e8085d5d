"""Greedy size-bounded packing of a group's items, exact without a whole group in one task.

Next-fit packing is sequential: where a shard starts depends on every item before it.  To run it
in parallel, each group is cut into consecutive blocks of its key order.  A block maps "bytes used
in the open shard on entry" to "bytes used on exit, shards opened".  That map is a step function
with at most as many steps as items fit into one shard, so a block can report all of it.  Runs of
blocks are composed level by level, a bounded number per task; the states at the block entries
then let all blocks number their items at once.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from panelspark.session import cut_lineage

#: Blocks composed by one task per level.
FAN_IN = 16

_STEPS = "group string, node long, upto long, used long, shift long, shards long"
_ENTRY = "group string, node long, used long, opened long"


def document_overhead(group: Column, schema_version: str) -> Column:
    """Bytes of a shard document around its entries, for the group named ``group``."""
    frame = '{"municipalities":{},"schema_version":"' + schema_version + '","uf":}\n'
    # to_json gives {"v":"XX"}: six bytes around the encoded name.
    name = F.octet_length(F.to_json(F.struct(group.alias("v")))) - 6
    return (F.lit(len(frame.encode("utf-8"))) + name).cast("bigint")


def entry_bytes(key: Column, document: Column) -> Column:
    """Bytes of one ``"key":document`` entry."""
    encoded_key = F.octet_length(F.to_json(F.struct(key.alias("v")))) - 6
    return (encoded_key + 1 + F.octet_length(document)).cast("bigint")


def _starts(pdf):
    """Sorted block, running item bytes (one separator each) and where a shard begun at i ends."""
    import numpy as np

    pdf = pdf.sort_values("key", kind="stable")
    fixed, cap = int(pdf["fixed"].iloc[0]), int(pdf["cap"].iloc[0])
    running = np.concatenate([[0], np.cumsum(pdf["bytes"].to_numpy(np.int64) + 1)])
    stop = np.searchsorted(running, running[:-1] + (cap - fixed + 1), side="right") - 1
    return pdf, fixed, cap, running, stop


def _block_steps(pdf):
    import numpy as np
    import pandas as pd

    pdf, fixed, cap, running, stop = _starts(pdf)
    n = len(pdf)
    final, count = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in range(n - 1, -1, -1):
        j = int(stop[i])
        if j >= n:
            final[i], count[i] = fixed + running[n] - running[i] - 1, 1
        else:
            final[i], count[i] = final[j], count[j] + 1
    rows = []
    if cap - running[n] > 0:  # the whole block fits into the open shard
        rows.append((int(cap - running[n]), None, int(running[n]), 0))
    for k in range(min(n, int(np.searchsorted(running, cap, side="left"))) - 1, -1, -1):
        step = (int(cap - running[k]), int(final[k]), 0, int(count[k]))
        if rows and rows[-1][1:] == step[1:]:
            rows.pop()
        rows.append(step)
    steps = pd.DataFrame(rows, columns=["upto", "used", "shift", "shards"])
    steps["used"] = steps["used"].astype("Int64")
    steps.insert(0, "group", pdf["group"].iloc[0])
    steps.insert(1, "node", int(pdf["block"].iloc[0]))
    return steps


def _apply(steps, used: int) -> tuple[int, int]:
    """State after a node for the entry state ``used``; ``steps`` are (upto, used, shift, shards)."""
    from bisect import bisect_left

    uppers, rows = steps
    _, out, shift, shards = rows[bisect_left(uppers, used)]
    return (used + shift, 0) if out is None else (out, shards)


def _table(pdf):
    ordered = pdf.sort_values("upto")
    rows = [(int(u), None if o is None or o != o else int(o), int(s), int(c)) for u, o, s, c in zip(
        ordered["upto"], ordered["used"].astype(object).where(ordered["used"].notna(), None),
        ordered["shift"], ordered["shards"], strict=True)]
    return [r[0] for r in rows], rows


def _compose(first, second):
    """Steps of "first, then second"."""
    out, low = [], 0
    rows = second[1]
    for upto, used, shift, shards in first[1]:
        if used is not None:
            after, more = _apply(second, used)
            out.append((upto, after, 0, shards + more))
        else:
            for edge, b_used, b_shift, b_shards in rows:
                here = min(edge - shift, upto)
                if here > low:
                    out.append((here, b_used, shift + b_shift if b_used is None else 0, b_shards))
                    low = here
                if edge - shift >= upto:
                    break
        low = upto
    merged = []
    for row in out:
        if merged and row[1] is not None and merged[-1][1:] == row[1:]:
            merged.pop()
        merged.append(row)
    return [r[0] for r in merged], merged


def _compose_run(key, pdf):
    import pandas as pd

    group, parent = key
    table = None
    for _, node in pdf.groupby("node", sort=True):
        table = _table(node) if table is None else _compose(table, _table(node))
    out = pd.DataFrame(table[1], columns=["upto", "used", "shift", "shards"])
    out["used"] = out["used"].astype("Int64")
    out.insert(0, "group", group)
    out.insert(1, "node", int(parent))
    return out


def _descend_run(pdf):
    """Entry states of the children of one node whose own entry state is known."""
    import pandas as pd

    used, opened = int(pdf["entry_used"].iloc[0]), int(pdf["entry_opened"].iloc[0])
    rows = []
    for node, steps in pdf.groupby("node", sort=True):
        rows.append((pdf["group"].iloc[0], int(node), used, opened))
        used, more = _apply(_table(steps), used)
        opened += more
    return pd.DataFrame(rows, columns=["group", "node", "used", "opened"])


def _number_items(pdf):
    import numpy as np

    pdf, _, cap, running, stop = _starts(pdf)
    used, opened, n = int(pdf["used"].iloc[0]), int(pdf["opened"].iloc[0]), len(pdf)
    part = np.full(n, opened, np.int64)
    i = int(np.searchsorted(running, cap - used, side="right")) - 1
    while i < n:
        opened += 1
        j = min(int(stop[i]), n)
        part[i:j] = opened
        i = j
    out = pdf[["group", "key"]].copy()
    out["part"] = part
    return out


def pack_shards(items: DataFrame, group: str, key: str, size: str, max_bytes: int,
                overhead: Column | int = 0, blocks: int | None = None) -> DataFrame:
    """Shard number ``part`` (from 1) of each item and the number of ``parts`` of its group.

    Items are taken in key order.  A shard costs ``overhead`` bytes, its items and one separator
    byte between items; an item that cannot fit alone is an error.  Group and key are compared as
    text.  Only keys and sizes move between tasks, never the items themselves.  Items are cut into
    ``blocks`` key ranges (the session's shuffle partitions if not given).
    """
    if max_bytes < 1:
        raise ValueError("max_bytes must be positive")
    fixed = (F.lit(overhead) if isinstance(overhead, int) else overhead).cast("bigint")
    sized = items.select(F.col(group).cast("string").alias("group"),
                         F.col(key).cast("string").alias("key"),
                         F.col(size).cast("bigint").alias("bytes"), fixed.alias("fixed"))
    fits = F.col("fixed") + F.col("bytes") <= max_bytes
    sized = sized.withColumns({
        "bytes": F.when(fits, F.col("bytes")).otherwise(F.raise_error(F.concat(
            F.lit("item larger than a shard: "), F.col("group"), F.lit("/"), F.col("key")))),
        "cap": F.lit(max_bytes).cast("bigint")})
    count = blocks or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(sized.repartitionByRange(count, "group", "key")
                        .withColumn("block", F.spark_partition_id().cast("bigint")))
    entries = _entry_states(dealt, count, max_bytes)
    ready = dealt.join(entries.withColumnRenamed("node", "block"), ["group", "block"])
    numbered = ready.groupBy("group", "block").applyInPandas(
        _number_items, "group string, key string, part long")
    parts = numbered.groupBy("group").agg(F.max("part").alias("parts"))
    return numbered.join(parts, "group").select(
        F.col("group").alias(group), F.col("key").alias(key),
        F.col("part").cast("int").alias("part"), F.col("parts").cast("int").alias("parts"))


def _entry_states(blocks: DataFrame, count: int, max_bytes: int) -> DataFrame:
    """State of the open shard at the start of every block.

    "No shard open" behaves like a full shard: the next item opens a new one.
    """
    levels = [cut_lineage(blocks.groupBy("group", "block").applyInPandas(_block_steps, _STEPS))]
    width = count
    while width > 1:
        width = math.ceil(width / FAN_IN)
        below = levels[-1]
        levels.append(cut_lineage(
            below.groupBy("group", F.floor(F.col("node") / FAN_IN).alias("parent"))
            .applyInPandas(_compose_run, _STEPS)))
    entries = levels[-1].select("group", "node").distinct().select(
        "group", "node", F.lit(max_bytes).cast("bigint").alias("used"),
        F.lit(0).cast("bigint").alias("opened"))
    for steps in reversed(levels[:-1]):
        above = entries.select("group", F.col("node").alias("parent"),
                               F.col("used").alias("entry_used"), F.col("opened").alias("entry_opened"))
        children = steps.withColumn("parent", F.floor(F.col("node") / FAN_IN)).join(
            above, ["group", "parent"])
        entries = children.groupBy("group", "parent").applyInPandas(_descend_run, _ENTRY)
    return entries


def shard_name(group: Column, part: Column, parts: Column) -> Column:
    """``UF.json``, or ``UF-001.json`` when the group has more than one part.

    Numbers are padded to three digits and never cut.
    """
    number = part.cast("string")
    padded = F.when(part < 1000, F.lpad(number, 3, "0")).otherwise(number)
    return F.when(parts > 1, F.concat(group, F.lit("-"), padded, F.lit(".json"))).otherwise(
        F.concat(group, F.lit(".json")))


def shard_documents(entries: DataFrame, group: str, key: str, document: str, file: str, schema_version: str) -> DataFrame:
    """One row per shard (``file``, ``group``, ``body``): its whole JSON document, entries in key order.

    The body of a shard is bounded by the size it was packed for.
    """
    name = F.to_json(F.struct(F.col(key).cast("string").alias("v")))
    # to_json gives {"v":"key"}; the encoded name lies between its fifth and its last character.
    entry = F.struct(F.col(key).cast("string").alias("key"), F.concat(
        name.substr(F.lit(6), F.length(name) - 6), F.lit(":"), F.col(document)).alias("text"))
    named = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"])
    frame = F.expr(f"to_json(struct(`{group}` AS v))")
    return entries.groupBy(file, group).agg(F.array_join(named, ",").alias("__entries")).select(
        file, group, F.concat(F.lit('{"municipalities":{'), F.col("__entries"),
                              F.lit('},"schema_version":' + json.dumps(schema_version) + ',"uf":'),
                              F.substring(frame, 6, 1 << 20)).alias("body"))


def read_shard_documents(spark: SparkSession, path: str, identity: StructType | str) -> DataFrame:
    """What published shard files hold: ``file``, ``bytes``, ``schema_version``, ``uf``, key, identity.

    Each file is one JSON document of bounded size and is read whole.
    """
    texts = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"),
        F.from_json("value", "schema_version string, uf string, municipalities map<string,string>").alias("d"))
    rows = texts.select("file", "bytes", "d.schema_version", "d.uf",
                        F.explode_outer("d.municipalities").alias("codigo_ibge", "document"))
    held = identity if isinstance(identity, str) else identity.simpleString()
    return rows.withColumn("municipality", F.from_json("document", f"municipality {held}")["municipality"])
