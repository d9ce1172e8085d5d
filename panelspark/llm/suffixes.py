"""Repeated byte passages of proposal texts, found with suffix arrays over content-dealt segments.

A passage of ``length`` bytes contains ``length - GRAM + 1`` short byte strings; the one with the
smallest hash (the leftmost of equals) is its anchor.  Equal passages have equal anchors at equal
places, so passages can be dealt to tasks by anchor: no occurrence is missed, and passages whose
anchor occurs in one text only need not move at all.  A run of neighbouring passages with one anchor
travels as one segment of text.  Each task sorts the suffixes of its segments in two stages and reads
equal passages off adjacent common prefixes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import filter_passes, fixed_filter, text_or_empty
from panelspark.session import cut_lineage

LENGTH = 50
GRAM = 16
PIECE = 1 << 22
STRIP = 1 << 16
PART_BYTES = 1 << 21
CROWDED = 20_000

_M1, _M2, _M3 = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9))


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of the ``size`` bytes that start at each place; ``size`` is a power of two."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _M1
    h ^= h >> np.uint64(29)
    width = 1
    while width < size and len(h) > width:
        h = h[:-width] * _M2 + h[width:]
        h ^= h >> np.uint64(31)
        h *= _M3
        width *= 2
    return h if width == size else h[:0]


def window_minima(h: np.ndarray, size: int) -> np.ndarray:
    """Smallest value of each ``size`` consecutive ones."""
    if len(h) < size:
        return h[:0]
    width = 1
    while width * 2 <= size:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    rest = size - width
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def passage_minima(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The anchor of the passage that starts at each place, worked out in strips that fit a cache."""
    n = len(data) - length + 1
    return np.concatenate([window_minima(gram_hashes(data[at:at + STRIP + length - 1]), length - GRAM + 1)
                           for at in range(0, n, STRIP)]) if n > 0 else np.zeros(0, np.uint64)


def segments_of(texts: list[bytes], length: int = LENGTH):
    """(joined bytes, text number, first passage's place in the joined bytes, passages, anchor) of all segments."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    low = passage_minima(data, length)
    # Passages that run into the next text do not count, and a segment ends with its text.
    ok = np.ones(len(low) + length, bool)
    for end in ends.tolist():
        ok[max(0, end - length + 1):end] = False
    ok = ok[:len(low)]
    fresh = np.ones(len(low), bool)
    fresh[1:] = (low[1:] != low[:-1]) | ~ok[:-1]
    at = np.flatnonzero(fresh & ok)
    last = np.flatnonzero(ok & np.concatenate(((fresh | ~ok)[1:], [True]))) if len(low) else at
    # Minima are small numbers; mixed (one to one) they spread evenly over parts and filter.
    anchor = low[at] * _M1
    anchor ^= anchor >> np.uint64(32)
    return data, np.searchsorted(ends, at, side="right"), at, last - at + 1, anchor * _M2


def _pieces(batches):
    """Batches cut so that about PIECE bytes of text are in work at once."""
    for batch in batches:
        sizes = np.cumsum(np.fromiter((len(t.as_buffer()) for t in batch.column("body").cast(pa.large_binary())), np.int64, batch.num_rows))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + PIECE)))
            part = batch.slice(lo, hi - lo)
            yield part, part.column("body").cast(pa.large_binary()).to_pylist()
            lo = hi


def _parts_of(anchor: np.ndarray, parts: int) -> np.ndarray:
    """Sorted anchors' parts: even ranges of the leading bits."""
    return (anchor >> np.uint64(33)).astype(np.int64) * parts >> 31


# ---- which anchors can matter -------------------------------------------------------------------

def _anchor_parts(batches, parts: int):
    """Distinct anchors of each piece by part, with how often they occur and whether in several texts."""
    for _, texts in _pieces(batches):
        _, owner, _, _, anchor = segments_of(texts)
        order = np.argsort(anchor, kind="stable")
        anchor, owner = anchor[order], owner[order]
        edge = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate((edge, [len(anchor)]))).astype(np.int64)
        several = owner[edge] != owner[edge + size - 1]
        anchor = anchor[edge]
        # One text: 1 whatever it repeats; several texts: the number of places.
        count = np.minimum(np.where(several, size, 1), 255).astype(np.uint8)
        part = _parts_of(anchor, parts)
        used, first = np.unique(part, return_index=True)
        cuts = list(zip(first.tolist(), np.append(first[1:], len(part)).tolist()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array([_six(anchor[a:b]) for a, b in cuts], pa.binary()),
             pa.array([count[a:b].tobytes() for a, b in cuts], pa.binary())], names=["part", "anchors", "counts"])


def _six(values: np.ndarray) -> bytes:
    """The leading six bytes of each value: enough to tell anchors apart before the exact search."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return wide.view(">u8").ravel().astype(np.uint64)


def _lead(anchor: np.ndarray) -> np.ndarray:
    return anchor & ~np.uint64(0xFFFF)


def _several_of(table: pa.Table) -> pa.Table:
    """Anchors of one part that occur in more than one text, and which of them are crowded."""
    anchor = np.concatenate([_unsix(b) for b in table.column("anchors").to_pylist()])
    count = np.concatenate([np.frombuffer(b, np.uint8) for b in table.column("counts").to_pylist()])
    values, place = np.unique(anchor, return_inverse=True)
    total = np.bincount(place, count, len(values))
    found = total > 1
    return pa.table({"v": pa.array(values[found].view(np.int64)), "n": pa.array(total[found].astype(np.int64))})


# ---- suffix arrays ------------------------------------------------------------------------------

def two_stage_order(data: np.ndarray, wanted: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Places of ``wanted`` ordered by the suffixes that start there, to at least ``depth`` bytes.

    ``data`` has ``depth`` padding bytes at its end.  A suffix smaller than its successor (its first
    byte that differs from the next one is smaller) is sorted directly.  The rest are induced: when
    buckets of first bytes are scanned upwards, a place's predecessor that is larger than it is
    appended to the end of what its own bucket holds so far.
    """
    n = len(data)
    # Whether each suffix is smaller than its successor; equal bytes decide as the next byte does.
    differs = data[1:] != data[:-1]
    known = np.flatnonzero(differs)
    rises = np.append(data[known + 1] > data[known], True)
    # Before the k-th difference all places wait for it; after the last one the padding counts as rising.
    small = np.append(rises[np.cumsum(differs, dtype=np.int32) - differs], True)
    # Inducing needs every place from a wanted one on to the next directly sorted one.
    need = np.zeros(n, bool)
    need[wanted] = True
    directs = np.flatnonzero(small)
    stop = directs[np.searchsorted(directs, np.flatnonzero(need))]
    cover = np.bincount(np.flatnonzero(need), minlength=n + 1).astype(np.int32)
    cover -= np.bincount(stop + 1, minlength=n + 1).astype(np.int32)
    need = np.cumsum(cover[:-1], dtype=np.int32) > 0
    direct = np.flatnonzero(need & small)

    order = _sort_direct(data, direct, depth)
    first = data[order]
    edges = np.searchsorted(first, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger = need & ~small
    out = []
    for byte in range(256):
        # Induced suffixes of a bucket come before its direct ones.
        queue, at = induced[byte], 0
        while at < len(queue):
            _induce(data, larger, queue[at], induced)
            at += 1
        out += queue
        own = order[edges[byte]:edges[byte + 1]]
        _induce(data, larger, own, induced)
        out.append(own)
    ranked = np.concatenate(out) if out else direct
    keep = np.zeros(n, bool)
    keep[wanted] = True
    return ranked[keep[ranked]]


def _induce(data: np.ndarray, larger: np.ndarray, places: np.ndarray, induced: list) -> None:
    before = places[places > 0] - 1
    before = before[larger[before]]
    if not len(before):
        return
    byte = data[before]
    if (byte == byte[0]).all():
        induced[byte[0]].append(before)
        return
    order = np.argsort(byte, kind="stable")
    before, byte = before[order], byte[order]
    edge = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
    for b, part in zip(byte[edge].tolist(), np.split(before, edge[1:])):
        induced[b].append(part)


def _words(data: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The k-th eight bytes of each suffix as big-endian numbers, which sort like the bytes."""
    padded = np.concatenate([data[8 * k:], np.zeros(8 * k + 16, np.uint8)])
    view = np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1))
    return np.ascontiguousarray(view[places]).view(">u8").ravel().astype(np.uint64)


def _sort_direct(data: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Sort suffixes by at least ``depth`` bytes, eight at a time; only ties are looked at again."""
    if not len(places):
        return places
    order = places[np.argsort(_words(data, places, 0), kind="stable")]
    key = _words(data, order, 0)
    group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64))))
    open_ = np.arange(len(order))
    for k in range(1, -(-depth // 8)):
        # Places whose group has more than one member.
        same = group[open_]
        tied = np.zeros(len(open_), bool)
        tied[1:] |= same[1:] == same[:-1]
        tied[:-1] |= same[1:] == same[:-1]
        open_ = open_[tied]
        if not len(open_):
            break
        same = group[open_]
        key = _words(data, order[open_], k)
        inner = np.lexsort((key, same))
        order[open_] = order[open_][inner]
        key, same = key[inner], same[inner]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (same[1:] != same[:-1])))
        # A new group number for every run, unique because places in order are.
        group[open_] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0))]
    return order


def adjacent_equal(data: np.ndarray, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Whether each suffix of the order shares at least ``depth`` bytes with the one before it."""
    equal = np.ones(max(0, len(order) - 1), bool)
    for k in range(-(-depth // 8)):
        left = np.flatnonzero(equal)
        if not len(left):
            break
        key_a, key_b = _words(data, order[left], k), _words(data, order[left + 1], k)
        spare = 8 * (k + 1) - depth
        if spare > 0:
            key_a, key_b = key_a >> np.uint64(8 * spare), key_b >> np.uint64(8 * spare)
        equal[left] = key_a == key_b
    return np.concatenate(([False], equal)) if len(order) else equal


def earliest_ids(segments: list[bytes], passages: np.ndarray, ids: np.ndarray, length: int = LENGTH):
    """(segment, passage, smallest id of any segment that holds the passage) for all passages."""
    data = np.frombuffer(b"".join(segments) + bytes(length), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in segments])))[:-1]
    owner = np.repeat(np.arange(len(segments)), passages)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(passages) - passages, passages)
    place = starts[owner] + inside
    row = np.full(len(data), -1, np.int64)
    row[place] = np.arange(len(owner))
    order = two_stage_order(data, place, length)
    run = np.flatnonzero(~adjacent_equal(data, order, length))
    row = row[order]
    least = np.minimum.reduceat(ids[owner[row]], run)
    out = np.empty(len(owner), np.int64)
    out[row] = np.repeat(least, np.diff(np.concatenate((run, [len(row)]))))
    return owner, inside, out


def _runs(owner, inside, least, limit):
    """Neighbouring passages of a segment with one earliest id, where some text comes later than it."""
    useful = least < limit[owner]
    owner, inside, least = owner[useful], inside[useful], least[useful]
    if not len(owner):
        return owner, inside, inside, least
    fresh = np.concatenate(([True], (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1] + 1) | (least[1:] != least[:-1])))
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:], [len(owner)])) - 1
    return owner[first], inside[first], inside[last], least[first]


# ---- segments on their way ----------------------------------------------------------------------

def _digests(whole: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def _segment_rows(piece: pa.RecordBatch, texts: list[bytes], repeated: bytes, crowded: bytes):
    """The segments of a piece that may repeat, equal ones together: anchor, text span, digest, owner.

    Segments of a crowded anchor are taken apart into single passages, which are dealt by their own
    content, so that no task has to hold all texts around a very common string.
    """
    data, owner, at, passages, anchor = segments_of(texts)
    keep = filter_passes(_lead(anchor), repeated)
    owner, at, passages, anchor = owner[keep], at[keep], passages[keep], anchor[keep]
    whole = data.tobytes()
    if crowded:
        many = filter_passes(_lead(anchor), crowded)
        if many.any():
            n = passages[many]
            place = np.repeat(at[many], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own = _digests(whole, place, place + LENGTH, 1)
            owner, at = np.concatenate((owner[~many], np.repeat(owner[many], n))), np.concatenate((at[~many], place))
            passages = np.concatenate((passages[~many], np.ones(len(place), np.int64)))
            anchor = np.concatenate((anchor[~many], own))
    ends = at + passages + LENGTH - 1
    digest = _digests(whole, at, ends)
    ids = piece.column("id").to_numpy()[owner]
    order = np.lexsort((ids, digest, anchor))
    owner, at, ends, anchor, digest, ids = (x[order] for x in (owner, at, ends, anchor, digest, ids))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])
    first = np.flatnonzero(fresh)
    size = np.diff(np.concatenate((first, [len(order)]))).astype(np.int64)
    place = at - np.concatenate(([0], np.cumsum([len(t) for t in texts])))[owner]
    return whole, owner, at, ends, anchor, digest, ids, place, first, size


def _pack(*arrays) -> bytes:
    return zlib.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _leaders(batches, parts: int, repeated: bytes, crowded: bytes):
    """One packed row per piece and part: its different segments, with the place of those met once."""
    for piece, texts in _pieces(batches):
        whole, owner, at, ends, anchor, _, ids, place, first, size = _segment_rows(piece, texts, repeated, crowded)
        high = ids[first + size - 1]
        tags = piece.column("tag").to_numpy()[owner[first]]
        at, ends, anchor, low = at[first], ends[first], anchor[first], ids[first]
        # Segments met in several texts of the piece get their answer through a join instead.
        place = np.where(size > 1, -1, place[first])
        part = _parts_of(anchor, parts)
        used, start = np.unique(part, return_index=True)
        cuts = list(zip(start.tolist(), np.append(start[1:], len(part)).tolist()))
        text = [zlib.compress(b"".join([whole[x:y] for x, y in zip(at[a:b].tolist(), ends[a:b].tolist())]), 1) for a, b in cuts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(np.array([b - a for a, b in cuts], np.int64)),
             pa.array([anchor[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array(text, pa.binary()),
             pa.array([_pack((ends - at)[a:b], low[a:b], high[a:b] - low[a:b], place[a:b]) for a, b in cuts], pa.binary()),
             pa.array([np.where(place[a:b] < 0, 0, tags[a:b]).tobytes() for a, b in cuts], pa.binary())],
            names=["part", "n", "anchors", "text", "numbers", "tags"])


def _followers(batches, repeated: bytes, crowded: bytes):
    """Places of segments that several texts of a piece share."""
    for piece, texts in _pieces(batches):
        _, owner, _, _, anchor, digest, ids, place, _, size = _segment_rows(piece, texts, repeated, crowded)
        many = np.repeat(size, size) > 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor[many].view(np.int64)), pa.array(digest[many].view(np.int64)), pa.array(ids[many]),
             pa.array(piece.column("tag").to_numpy()[owner[many]]), pa.array(place[many])],
            names=["anchor", "digest", "id", "tag", "at"])


def _solve(rows: list[dict]) -> pa.RecordBatch:
    """Answers for all segments of one part: spans of segments met once, decisions for the rest."""
    anchors, sizes, lows, highs, places, tags, texts = [], [], [], [], [], [], []
    for row in rows:
        numbers = np.frombuffer(zlib.decompress(row["numbers"]), np.int64).reshape(4, row["n"])
        anchors.append(np.frombuffer(row["anchors"], np.uint64))
        sizes.append(numbers[0])
        lows.append(numbers[1])
        highs.append(numbers[1] + numbers[2])
        places.append(numbers[3])
        tags.append(np.frombuffer(row["tags"], np.int64))
        texts.append(zlib.decompress(row["text"]))
    anchor, size, low, high, place, tag = (np.concatenate(x) for x in (anchors, sizes, lows, highs, places, tags))
    whole = b"".join(texts)
    ends = np.cumsum(size)
    digest = _digests(whole, ends - size, ends)
    order = np.lexsort((digest, anchor))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (anchor[order][1:] != anchor[order][:-1]) | (digest[order][1:] != digest[order][:-1])
    first = np.flatnonzero(fresh)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    # Equal segments are sorted once, under the smallest id that has them.
    one = order[first]
    segments = [whole[a:b] for a, b in zip((ends - size)[one].tolist(), ends[one].tolist())]
    least = np.minimum.reduceat(low[order], first)
    limit = np.maximum.reduceat(high[order], first)
    shared = np.maximum.reduceat((place[order] < 0).astype(np.int8), first) > 0
    run, start, stop, value = _runs(*earliest_ids(segments, size[one] - LENGTH + 1, least), limit)
    # Spans of the segments met once.
    single = np.flatnonzero(place >= 0)
    lo = np.searchsorted(run, number[single])
    count = np.searchsorted(run, number[single], side="right") - lo
    who = np.repeat(single, count)
    which = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if len(count) else lo
    later = value[which] < low[who]
    who, which = who[later], which[later]
    spans = [place[who] + start[which], place[who] + stop[which] + LENGTH]
    # Decisions for the others.
    told = np.flatnonzero(shared[run])
    n, m = len(who), len(told)
    where = one[run[told]]
    none = np.arange(n + m) < n
    join = lambda a, b: np.concatenate((a, b)).astype(np.int64)
    zero, nil = np.zeros(n, np.int64), np.zeros(m, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(join(zero, anchor[where].view(np.int64)), mask=none), pa.array(join(zero, digest[where].view(np.int64)), mask=none),
         pa.array(join(low[who], nil), mask=~none), pa.array(join(tag[who], nil), mask=~none),
         pa.array(join(spans[0], start[told])), pa.array(join(spans[1], stop[told] + LENGTH)),
         pa.array(join(zero, value[told]), mask=none)],
        names=["anchor", "digest", "id", "tag", "first", "last", "least"])


def _search(batches):
    """Parts arrive in order; each is solved when the next one begins."""
    held: list[dict] = []
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            if held and row["part"] != held[0]["part"]:
                yield _solve(held)
                held = []
            held.append(row)
    if held:
        yield _solve(held)


# ---- the operator -------------------------------------------------------------------------------

def repeated_bytes(proposals: DataFrame, id: str = "ID_PROPOSTA", text: str = "OBJETO_PROPOSTA",
                   part_bytes: int = PART_BYTES, crowded: int = CROWDED) -> DataFrame:
    """Bytes of proposal texts that repeat a 50-byte passage of an earlier proposal.

    A byte is removed if some 50-byte string that covers it also starts in the text of a smaller id;
    strings are judged on the input and never cross texts.  Returns one row per row: ``id``,
    ``n_bytes``, ``removed`` (ascending spans [start, end) in bytes, apart from each other) and
    ``kept`` (the remaining bytes, binary).

    Ids are compared as whole numbers (digit strings are read as such).  A row with another or a
    null id is later than no row and earlier than none: it stays whole.  Rows that share an id do not
    affect each other.  Null and empty texts have no bytes.

    ``part_bytes`` is the amount of text whose anchors share a task's working set; anchors that occur
    more than ``crowded`` times are dealt by single passages.  Neither changes a result.
    """
    spark = proposals.sparkSession
    body = text_or_empty(text)
    named = proposals.select(F.col(id).alias("key"), F.expr(f"try_cast(`{id}` AS bigint)").alias("id"),
                             F.xxhash64(body).alias("tag"), body.alias("body"))
    rows = named.filter("id IS NOT NULL").select("id", "tag", "body")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("body").cast("long")), F.lit(0))).first()[0]
    parts = int(min(1 << 30, max(64, total // part_bytes)))

    several = cut_lineage(rows.mapInArrow(lambda b: _anchor_parts(b, parts), "part long, anchors binary, counts binary")
                          .groupBy("part").applyInArrow(_several_of, "v long, n long"))
    repeated = spark.sparkContext.broadcast(fixed_filter(several.select("v")))
    many = several.filter(F.col("n") > crowded).select("v")
    common = spark.sparkContext.broadcast(fixed_filter(many) if many.limit(1).count() else b"")

    kind = "anchor long, digest long, id long, tag long, first long, last long, least long"
    solved = cut_lineage(
        rows.mapInArrow(lambda b: _leaders(b, parts, repeated.value, common.value),
                        "part long, n long, anchors binary, text binary, numbers binary, tags binary")
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part")
        .mapInArrow(_search, kind))
    decisions = solved.filter("id IS NULL").select("anchor", "digest", "first", "last", "least")
    shared = (rows.mapInArrow(lambda b: _followers(b, repeated.value, common.value),
                              "anchor long, digest long, id long, tag long, at long")
              .join(decisions, ["anchor", "digest"]).filter(F.col("least") < F.col("id"))
              .select("id", "tag", (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last")))
    spans = solved.filter("id IS NOT NULL").select("id", "tag", "first", "last").unionByName(shared)
    # A span as one number: its start and its length.
    spans = (spans.select("id", "tag", (F.shiftleft("first", 32) + F.col("last") - F.col("first")).alias("span"))
             .groupBy(F.col("id").alias("doc"), F.col("tag").alias("same")).agg(F.collect_list("span").alias("spans")))
    texts = named.mapInArrow(_squeeze, f"key {proposals.schema[id].dataType.simpleString()}, id long, tag long, body binary")
    joined = texts.join(spans, (F.col("id") == F.col("doc")) & (F.col("tag") == F.col("same")), "left")
    out = joined.select("key", "body", "spans").mapInArrow(
        _apply, f"key {proposals.schema[id].dataType.simpleString()}, n_bytes long, "
                "removed array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("key", id)


def _squeeze(batches):
    """Texts packed for the way to their spans."""
    for batch in batches:
        packed = pa.array([zlib.compress(t, 1) for t in batch.column("body").cast(pa.large_binary()).to_pylist()], pa.binary())
        yield batch.set_column(batch.schema.get_field_index("body"), "body", packed)


def _apply(batches):
    """Spans joined where they overlap or touch, and the bytes outside them."""
    for batch in batches:
        sizes, removed, kept = [], [], []
        for body, spans in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist()):
            body, runs, at, parts = zlib.decompress(body), [], 0, []
            for start, end in sorted((s >> 32, (s >> 32) + (s & 0xFFFFFFFF)) for s in spans or ()):
                if runs and start <= runs[-1]["end"]:
                    runs[-1]["end"] = max(runs[-1]["end"], end)
                else:
                    runs.append({"start": start, "end": end})
            for run in runs:
                parts.append(body[at:run["start"]])
                at = run["end"]
            sizes.append(len(body))
            removed.append(runs)
            kept.append(b"".join([*parts, body[at:]]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(sizes, pa.int64()),
             pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
            names=["key", "n_bytes", "removed", "kept"])
