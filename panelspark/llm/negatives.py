"""Hard negatives: units outside a unit's peer group that resemble it almost as much as its peers do."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelspark.llm.common import stage_table
from panelspark.llm.topk import CELL_QUERIES, CELL_UNITS, CHUNK, _exact_type

POSITIVES = 5
NEGATIVES = 5
LEAST = 80


def _first(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` of ``rows`` that come first by falling score, ties by smaller id."""
    if len(rows) > k:
        edge = np.partition(score[rows], len(rows) - k)[len(rows) - k]
        rows = rows[score[rows] >= edge]
    return rows[np.lexsort((ids[rows], -score[rows]))[:k]]


def _blocks(units: pa.Table, anchors: pa.Table):
    """Scores of a cell: (anchor row, scores of all units, same group, another id), a chunk of anchors at a time."""
    def matrix(table: pa.Table) -> np.ndarray:
        values = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return values.reshape(len(table), -1)

    x, q = matrix(units), matrix(anchors)
    kind = _exact_type(x, q)
    x, q = x.astype(kind), q.astype(kind)

    def coded(name: str) -> tuple[np.ndarray, np.ndarray]:
        both = np.asarray(units.column(name).to_pylist() + anchors.column(name).to_pylist())
        code = np.unique(both, return_inverse=True)[1]
        return code[:len(x)], code[len(x):]

    unit_group, anchor_group = coded("group")
    unit_id, anchor_id = coded("id")
    for lo in range(0, len(q), CHUNK):
        scores = (q[lo:lo + CHUNK] @ x.T).astype(np.int64)
        for i, score in enumerate(scores, lo):
            yield i, score, unit_group == anchor_group[i], unit_id != anchor_id[i], unit_id


def _windows(batches: Iterator[pa.RecordBatch], positives: int, negatives: int, least: int) -> Iterator[pa.RecordBatch]:
    """One pass over pairs in the order (anchor, falling score, id).

    A peer opens a window from its score down to ``least`` percent of it; units of other groups fall
    into all open windows.  Only the open windows, and the first units of another group at the present
    score, are held: a peer of that score with a larger id takes them too.
    """
    anchor, opened, windows, level, tied = None, 0, [], None, []
    for batch in batches:
        out = []
        for id, tag, score, unit, peer in zip(*(batch.column(c).to_pylist() for c in range(5))):
            if (id, tag) != anchor:
                anchor, opened, windows, level = (id, tag), 0, [], None
            if score != level:
                level, tied = score, []
                windows = [w for w in windows if w[2] < negatives and least * w[1] <= 100 * score]
            if peer:
                if opened < positives:
                    opened += 1
                    # A negative score is below its own lower limit.
                    if score >= 0:
                        out.extend((id, unit, rank, other, score, score) for rank, other in enumerate(tied, 1))
                        windows.append([unit, score, len(tied)])
            else:
                if len(tied) < negatives:
                    tied.append(unit)
                for w in windows:
                    if w[2] < negatives:
                        w[2] += 1
                        out.append((id, w[0], w[2], unit, w[1], score))
        columns = list(zip(*out)) or [()] * 6
        kind = batch.schema.field(0).type
        kinds = (kind, kind, pa.int32(), kind, pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[
            "anchor", "positive", "rank", "negative", "positive_score", "negative_score"])


def hard_negatives(units: DataFrame, anchors: DataFrame, id: str = "codigo_ibge", profile: str = "perfil",
                   group: str = "codigo_regiao_imediata", positives: int = POSITIVES, negatives: int = NEGATIVES,
                   least: int = LEAST, cell_units: int = CELL_UNITS, cell_anchors: int = CELL_QUERIES) -> DataFrame:
    """Units of other groups whose profiles score nearly as high as an anchor unit's nearest peers.

    A profile is an array of integers, such as a unit's whole hectares per land-cover class; a score
    is the inner product of two profiles; peers share ``group``.  The positives of an anchor are its
    first ``positives`` peers by falling score, ties by smaller id.  For each of them the first
    ``negatives`` units of other groups follow whose score is at least ``least`` percent of the
    positive's and not above it.  Returns ``anchor``, ``positive``, ``rank`` (from 1), ``negative``,
    ``positive_score``, ``negative_score``; fewer rows where there are fewer units, none for a positive
    of negative score, no row for an anchor without peers.

    Rows with a null id, group, profile or component take no part; profiles are compared with those
    of the same length; an empty one scores zero.  A unit is never its own peer (same id).  Units that repeat an id
    are units of their own, an anchor row that is repeated in full counts once.  Other columns are ignored.
    Products must fit 64 bits.

    Units meet anchors in cells of bounded size.  A first pass finds the scores of each anchor's
    peers; a second one packs the pairs that can matter into (anchor, falling score, id) keys: of
    each cell, the first peers, and the first units of other groups below each peer's score.  One
    secondary sort brings an anchor's pairs into order, and a pass over the sorted rows opens a
    window at each peer.  What a task holds is one cell, or five windows.
    """
    def ready(df: DataFrame) -> DataFrame:
        ok = (F.col(id).isNotNull() & F.col(group).isNotNull() & F.col(profile).isNotNull()
              & ~F.exists(profile, lambda v: v.isNull()))
        return df.filter(ok).select(F.col(id).alias("id"), F.col(group).alias("group"),
                                    F.col(profile).cast("array<long>").alias("v"), F.size(profile).alias("d"))

    # Rows are dealt by their place in a written table, so that repeated rows spread and a rerun agrees.
    place = F.xxhash64(F.monotonically_increasing_id())
    units = stage_table(ready(units).withColumn("at", place))
    anchors = stage_table(ready(anchors).withColumn("tag", F.xxhash64("group", "v"))
                          .dropDuplicates(["id", "tag", "d"]).withColumn("at", place))
    across = max(1, -(-units.count() // cell_units))
    down = max(1, -(-anchors.count() // cell_anchors))
    units = (units.withColumn("g", F.pmod("at", F.lit(across)).cast("int"))
             .withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))))
    anchors = (anchors.withColumn("h", F.pmod("at", F.lit(down)).cast("int"))
               .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))))
    kind = units.schema["id"].dataType.simpleString()
    cell = ["d", "g", "h"]

    def peers(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, scores = [], []
        if len(left) and len(right):
            for i, score, same, other, ids in _blocks(left, right):
                best = _first(score, ids, np.flatnonzero(same & other), positives)
                rows += [i] * len(best)
                scores += score[best].tolist()
        at = pa.array(rows, pa.int64())
        return pa.table({"id": right.column("id").take(at), "tag": right.column("tag").take(at),
                         "score": pa.array(scores, pa.int64())})

    best = Window.partitionBy("id", "tag").orderBy(F.desc("score"))
    peaks = (units.groupBy(*cell).cogroup(anchors.groupBy(*cell)).applyInArrow(peers, f"id {kind}, tag long, score long")
             .withColumn("n", F.row_number().over(best)).filter(F.col("n") <= positives)
             .groupBy("id", "tag").agg(F.collect_set("score").alias("peaks")))

    def pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, found, scores, peer = [], [], [], []
        if len(left) and len(right):
            tops = right.column("peaks").to_pylist()
            for i, score, same, other, ids in _blocks(left, right):
                mates = _first(score, ids, np.flatnonzero(same & other), positives)
                low = min((t for t in tops[i] if t >= 0), default=None)
                near = set()
                if low is not None:
                    rest = np.flatnonzero(~same & other & (100 * score >= least * low))
                    for top in tops[i]:
                        inside = rest[(score[rest] <= top) & (100 * score[rest] >= least * top)]
                        near.update(_first(score, ids, inside, negatives).tolist())
                both = [*mates.tolist(), *near]
                rows += [i] * len(both)
                found += both
                scores += score[both].tolist()
                peer += [True] * len(mates) + [False] * len(near)
        at = pa.array(rows, pa.int64())
        return pa.table({"anchor": right.column("id").take(at), "tag": right.column("tag").take(at),
                         "score": pa.array(scores, pa.int64()),
                         "unit": left.column("id").take(pa.array(found, pa.int64())), "peer": pa.array(peer, pa.bool_())})

    keyed = (units.groupBy(*cell).cogroup(anchors.join(peaks, ["id", "tag"]).groupBy(*cell))
             .applyInArrow(pairs, f"anchor {kind}, tag long, score long, unit {kind}, peer boolean"))
    ordered = (keyed.repartition("anchor", "tag")
               .sortWithinPartitions("anchor", "tag", F.desc("score"), "unit"))
    mined = ordered.mapInArrow(lambda batches: _windows(batches, positives, negatives, least),
                               f"anchor {kind}, positive {kind}, rank int, negative {kind}, positive_score long, negative_score long")
    return mined
