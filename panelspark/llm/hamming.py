"""Pairs of 64-bit fingerprints within a few bits, without pairing large buckets."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelspark.session import cut_lineage

BUCKET = 48


def mask_of(bits) -> int:
    """Bits as a signed 64-bit integer."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def agreeing(mask: int, parts: int, spoilt: int) -> list[int]:
    """Masks that also agree on all but ``spoilt`` of ``parts`` equal parts of the bits ``mask`` leaves open."""
    free = [b for b in range(64) if not (mask >> b) & 1]
    cuts = [free[len(free) * k // parts:len(free) * (k + 1) // parts] for k in range(parts)]
    return [mask | mask_of(b for cut in chosen for b in cut) for chosen in combinations(cuts, parts - spoilt)]


def _options(tables: dict[int, list[int]]) -> Column:
    """The masks of a row's path, as a literal looked up by ``path``."""
    listed = ", ".join(f"{path}, CAST(array({', '.join(f'{m}L' for m in masks)}) AS array<bigint>)"
                       for path, masks in tables.items())
    return F.element_at(F.expr(f"map({listed})"), F.col("path"))


def _pairs_of(batches, tables: dict, before: dict, distance: int, bucket: int | None):
    """Pairs of small buckets, and the members of large ones, from rows ordered by bucket.

    Rows are (path, slot, fp); members of a large bucket leave as (path, slot, fp, null) as they come,
    so no more than ``bucket`` rows of one bucket are ever held.
    """
    masks = {path: np.array(m, np.int64) for path, m in tables.items()}
    passed = {path: np.array(m, np.int64) for path, m in before.items()}

    def solve(path, slot, key, fp):
        edge = np.flatnonzero(np.concatenate(([True], (path[1:] != path[:-1]) | (slot[1:] != slot[:-1]) | (key[1:] != key[:-1]))))
        size = np.diff(np.concatenate((edge, [len(fp)])))
        sizes = np.repeat(size, size)
        large = sizes > bucket if bucket else np.zeros(len(fp), bool)
        inner = np.arange(len(fp)) - np.repeat(edge, size)
        left, right = [], []
        open_ = np.flatnonzero(~large & (sizes > 1))
        for gap in range(1, int(sizes[open_].max(initial=1))):
            i = open_[inner[open_] + gap < sizes[open_]]
            i = i[np.bitwise_count((fp[i] ^ fp[i + gap]).view(np.uint64)) <= distance]
            left.append(i)
            right.append(i + gap)
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        first = np.ones(len(i), bool)
        for p in np.unique(path[i]).tolist():
            at = np.flatnonzero(path[i] == p)
            diff = (fp[i[at]] ^ fp[j[at]])[:, None]
            own = np.arange(len(masks[p])) < slot[i[at], None]
            first[at] = ~(((diff & masks[p]) == 0) & own).any(axis=1) & ~((diff & passed[p]) == 0).any(axis=1)
        i, j = i[first], j[first]
        many = np.flatnonzero(large)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((path[i], path[many])), pa.int32()), pa.array(np.concatenate((slot[i], slot[many])), pa.int32()),
             pa.array(np.concatenate((fp[i], fp[many]))),
             pa.array(np.concatenate((fp[j], fp[many])), mask=np.arange(len(i) + len(many)) >= len(i))],
            names=["path", "slot", "a", "b"])

    held = None
    for batch in batches:
        part = [batch.column(k).to_numpy() for k in range(4)]
        # What is held is the start of a bucket that may go on.
        held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
        if not len(held[3]):
            continue
        path, slot, key, fp = held
        last = int(np.flatnonzero((path != path[-1]) | (slot != slot[-1]) | (key != key[-1]))[-1] + 1) \
            if ((path != path[-1]) | (slot != slot[-1]) | (key != key[-1])).any() else 0
        if bucket and len(fp) - last > bucket:
            # The open bucket is large already: its rows may go, but for enough to know it by.
            keep = len(fp) - bucket - 1
            if last:
                yield solve(path[:last], slot[:last], key[:last], fp[:last])
            many = slice(last, keep) if keep > last else slice(0, 0)
            n = len(fp[many])
            yield pa.RecordBatch.from_arrays(
                [pa.array(path[many], pa.int32()), pa.array(slot[many], pa.int32()), pa.array(fp[many]), pa.nulls(n, pa.int64())],
                names=["path", "slot", "a", "b"])
            held = [x[max(last, keep):] for x in held]
        else:
            if last:
                yield solve(path[:last], slot[:last], key[:last], fp[:last])
            held = [x[last:] for x in held]
    if held is not None and len(held[3]):
        yield solve(*held)


def close_pairs(prints: DataFrame, distance: int, masks: list[int], parts: int, levels: int,
                bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of fingerprints that differ in at most ``distance`` bits.

    ``prints`` has one column ``fp`` of distinct fingerprints.  Two close fingerprints agree on one of
    ``masks`` at least.  Only fingerprints that share a bucket (mask and masked value) are paired; a
    bucket above ``bucket`` rows is not paired but cut again, by the agreement that must hold on all
    but ``distance`` of ``parts`` parts of its open bits.  After ``levels`` levels a bucket's distinct
    fingerprints are bounded by its open bits.  Nothing is dropped, and each pair is found in the
    first bucket that holds it only.
    """
    rows = prints.select("fp", F.lit(0).alias("path"))
    # Per path: the masks of its buckets, and those of the buckets that come before the path's own.
    tables, before, found = {0: masks}, {0: []}, None
    for level in range(levels):
        last, width = level == levels - 1, max(map(len, tables.values()))
        limit = None if last else bucket
        key = F.col("fp").bitwiseAND(F.element_at(_options(tables), F.col("slot") + 1))
        # The masked value is worked out again after the exchange instead of travelling.
        dealt = (rows.select("path", F.explode(F.sequence(F.lit(0), F.size(_options(tables)) - 1)).alias("slot"), "fp")
                 .repartition(F.xxhash64("path", "slot", key))
                 .select("path", "slot", key.alias("key"), "fp").sortWithinPartitions("path", "slot", "key"))
        out = cut_lineage(dealt.mapInArrow(
            lambda b, t=tables, p=before, n=limit: _pairs_of(b, t, p, distance, n), "path int, slot int, a long, b long"))
        pairs = out.filter("b IS NOT NULL").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        rows = out.filter("b IS NULL").select(F.col("a").alias("fp"), (F.col("path") * width + F.col("slot") + 1).alias("path"))
        if last or not rows.limit(1).count():
            break
        before = {path * width + k + 1: before[path] + chosen[:k]
                  for path, chosen in tables.items() for k in range(len(chosen))}
        tables = {path * width + k + 1: agreeing(m, parts, distance)
                  for path, chosen in tables.items() for k, m in enumerate(chosen)}
    return found
