"""Exact top-k units by profile similarity, read from sorted lists without random access."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

K = 5
CELL_UNITS = 16_384
CELL_QUERIES = 4_096
CHUNK = 256
DEPTHS = (16, 6, 3, 1.7)


def _exact_type(x: np.ndarray, q: np.ndarray):
    """The cheapest number type in which every inner product and bound is exact."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1]) * 4
    return np.float32 if most < 2 ** 24 else np.float64 if most < 2 ** 53 else np.int64


class SortedLists:
    """One descending list per component over the units of a cell.

    A query reads a list from the top where its own component is positive and from the bottom where
    it is negative, so that contributions come in falling order.  Reading all lists to one depth for
    a chunk of queries at once is a product of the queries' components with the values read so far.
    """

    def __init__(self, x: np.ndarray, kind):
        n, d = x.shape
        order = np.argsort(-x, axis=0, kind="stable")
        self.x, self.kind = x.astype(kind), kind
        self.place = np.empty((n, d), np.int32)
        np.put_along_axis(self.place, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
        self.falling = np.take_along_axis(x, order, axis=0).astype(kind)

    def read(self, depth: int):
        """Per unit what is read at ``depth``, the values at both frontiers, and both extremes."""
        n = len(self.x)
        top, bottom = self.place < depth, self.place >= n - depth
        seen = np.concatenate([self.x * top, self.x * bottom], axis=1)
        edge = np.concatenate([self.falling[depth - 1], self.falling[n - depth]])
        least = np.concatenate([self.falling[-1], self.falling[0]])
        read = np.concatenate([top, bottom], axis=1).astype(self.kind)
        return seen, read, edge, least


def _search(lists: SortedLists, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int) -> list[tuple]:
    """(query row, unit row, score) of each query's k best, ties to the smaller id.

    Lower bound of a unit: what was read, and the list's least value for what was not.  Upper bound:
    the frontier instead.  Depths grow until few units' upper bounds reach the k-th lower bound;
    outsiders cannot qualify then, and the scores of those that can are resolved.
    """
    n = len(ids)
    rows = np.arange(len(q))
    split = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1).astype(lists.kind)
    own = q_ids[:, None] == ids[None, :]
    out = []
    depths = sorted({min(n, max(1, int(n / part))) for part in DEPTHS} | {n})
    for depth in depths:
        if not len(rows):
            break
        part = split[rows]
        if depth == n:
            upper = (q[rows].astype(lists.kind) @ lists.x.T)
            lower = upper
        else:
            seen, read, edge, least = lists.read(depth)
            known = part @ seen.T
            upper = known + ((part @ edge)[:, None] - (part * edge) @ read.T)
            lower = known + ((part @ least)[:, None] - (part * least) @ read.T)
        floor = np.iinfo(np.int64).min // 2 if lists.kind is np.int64 else -np.inf
        hidden = own[rows]
        lower = np.where(hidden, floor, lower)
        others = n - hidden.sum(axis=1)
        kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(rows), floor)
        can = (upper >= kth[:, None]) & ~hidden
        stop = (can.sum(axis=1) <= np.maximum(2 * k, n // 64)) | (depth == n) | (others <= k)
        for i in np.flatnonzero(stop):
            left = np.flatnonzero(can[i])
            score = lists.x[left] @ q[rows[i]].astype(lists.kind)
            best = np.lexsort((ids[left], -score))[:k]
            out.extend((int(rows[i]), int(left[j]), int(score[j])) for j in best)
        rows = rows[~stop]
    return out


def nearest_profiles(units: DataFrame, queries: DataFrame, id: str = "codigo_ibge", profile: str = "perfil",
                     k: int = K, cell_units: int = CELL_UNITS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """The ``k`` units whose integer profiles have the highest inner product with each query unit's.

    A profile is an array of integers, such as a unit's whole hectares per land-cover class.
    Returns ``query`` (id), ``rank`` (from 1), ``id``, ``score``, at most ``k`` rows per query row
    (fewer if there are fewer other units); ties go to the smaller id.

    A unit is never its own result (same id).  Null profiles, null components and null ids take no
    part; profiles are compared with those of the same length.  Rows that repeat an id count as
    units of their own; queries must have distinct ids.

    Units and queries are dealt by hash into cells of bounded size; each cell of units meets each
    cell of queries in one task, and only k rows per query and cell go on.
    """
    def ready(df: DataFrame) -> DataFrame:
        ok = (F.col(id).isNotNull() & F.col(profile).isNotNull() & ~F.exists(profile, lambda v: v.isNull()))
        return df.filter(ok).select(F.col(id).alias("id"), F.col(profile).cast("array<long>").alias("v"),
                                    F.size(profile).alias("d"))

    units, queries = ready(units), ready(queries)
    across = max(1, -(-units.count() // cell_units))
    down = max(1, -(-queries.count() // cell_queries))
    dealt = F.pmod(F.xxhash64("id", "v"), F.lit(across)).cast("int")
    units = units.withColumn("g", dealt).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    dealt = F.pmod(F.xxhash64("id"), F.lit(down)).cast("int")
    queries = queries.withColumn("h", dealt).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    kind = queries.schema["id"].dataType.simpleString()

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        column = table.column("v").combine_chunks()
        values = column.flatten().to_numpy(zero_copy_only=False)
        values = values.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)
        keys = table.column("id").combine_chunks()
        return values, np.asarray(keys.to_pylist()), keys

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        x, ids, unit_ids = matrix(left)
        q, q_ids, query_ids = matrix(right)
        found = []
        if len(x) and len(q):
            lists = SortedLists(x, _exact_type(x, q))
            for lo in range(0, len(q), CHUNK):
                found += [(lo + i, j, s) for i, j, s in
                          _search(lists, ids, q[lo:lo + CHUNK], q_ids[lo:lo + CHUNK], k)]
        return pa.table({"query": query_ids.take(pa.array([f[0] for f in found], pa.int64())),
                         "id": unit_ids.take(pa.array([f[1] for f in found], pa.int64())),
                         "score": pa.array([f[2] for f in found], pa.int64())})

    best = (units.groupBy("d", "g", "h").cogroup(queries.groupBy("d", "g", "h"))
            .applyInArrow(cell, f"query {kind}, id {kind}, score long"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query", "rank", F.col("id").alias(id), "score"))
