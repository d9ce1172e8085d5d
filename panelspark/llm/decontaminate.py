"""Evaluation items inside proposal texts, found with a generalised suffix automaton."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import text_or_empty, words_of

WINDOW = 13
COVERAGE = 20
BLOCK_WORDS = 200_000


class Known(dict):
    """Word numbers; 0 for a word of no item."""

    def __missing__(self, word):
        return 0


class Automaton:
    """Suffix automaton of several word sequences: every path from the start is a run of some item."""

    def __init__(self, items: list[tuple], window: int):
        self.window, self.words = window, Known()
        self.next, self.link, self.length = [{}], [-1], [0]
        self.items, self.short = {}, {}
        sequences = []
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words_of(text)]
            if ids:
                sequences.append((item, ids))
                self._insert(ids)
        self.least = min((min(window, len(ids)) for _, ids in sequences), default=1)
        for item, ids in sequences:
            state, length = 0, 0
            for c in ids:
                state, length = self.step(state, length, c)
                if length >= window:
                    self.items.setdefault(self._of_length(state, window), set()).add(item)
            if len(ids) < window:
                self.short.setdefault(self._of_length(state, len(ids)), {}).setdefault(len(ids), set()).add(item)
        # The nearest state along suffix links (itself included) where a short item ends.
        self.ends = [-1] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.ends[state] = state if state in self.short else self.ends[self.link[state]] if self.link[state] > 0 else -1

    def _add(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, target: int, c: int) -> int:
        """A copy of ``target`` holding only the runs that end with ``state`` then ``c``."""
        copy = self._add(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(c) == target:
            self.next[state][c] = copy
            state = self.link[state]
        return copy

    def _insert(self, ids: list[int]) -> None:
        last = 0
        for c in ids:
            target = self.next[last].get(c)
            if target is not None:
                last = target if self.length[target] == self.length[last] + 1 else self._split(last, target, c)
                continue
            new, state = self._add(self.length[last] + 1, {}, 0), last
            while state >= 0 and c not in self.next[state]:
                self.next[state][c] = new
                state = self.link[state]
            if state >= 0:
                target = self.next[state][c]
                self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, target, c)
            last = new

    def _of_length(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of a match."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """Longest run of an item that ends with ``c`` after a match of ``length`` words."""
        target = self.next[state].get(c)
        while target is None and state:
            state = self.link[state]
            length = self.length[state]
            target = self.next[state].get(c)
        return (0, 0) if target is None else (target, length + 1)

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans [first, last) of words inside occurring windows, and the items these belong to."""
        ids = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ids > 0, [0]))))
        spans, items = [], set()
        # A word of no item resets the match, so only runs of item words are streamed.
        for first, last in edge.reshape(-1, 2).tolist():
            if last - first < self.least:
                continue
            state, length = 0, 0
            for i, c in enumerate(ids[first:last].tolist(), first + 1):
                state, length = self.step(state, length, c)
                hit = 0
                if length >= self.window:
                    hit = length
                    items |= self.items[self._of_length(state, self.window)]
                end = self.ends[state]
                while end > 0:
                    for size, names in self.short[end].items():
                        if size <= length:
                            hit = max(hit, size)
                            items |= names
                    end = self.ends[self.link[end]] if self.link[end] > 0 else -1
                if hit:
                    start = i - hit
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        return spans, items


_RESULT = "n_words long, spans array<struct<first:long,last:long>>, items array<string>"


def _search_block(rows: DataFrame, items: list[tuple], window: int) -> DataFrame:
    """One scan of the texts against one bounded block of items; other columns pass through."""
    # Pickled by value, so that executors need no copy of this class.
    shared = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps(Automaton(items, window)))

    def run(batches):
        automaton = pickle.loads(shared.value)
        for batch in batches:
            at = batch.schema.get_field_index("body")
            found = []
            for text in batch.column(at).cast(pa.large_binary()).to_pylist():
                words = words_of(text)
                spans, names = automaton.search(words)
                found.append((len(words), [{"first": a, "last": b} for a, b in spans], sorted(n for n in names if n is not None)))
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept),
                 pa.array([f[0] for f in found], pa.int64()),
                 pa.array([f[1] for f in found], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                 pa.array([f[2] for f in found], pa.list_(pa.string()))],
                names=[*(batch.schema.names[i] for i in kept), "n_words", "spans", "items"])

    parts = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "body")
    return rows.mapInArrow(run, f"{parts}, {_RESULT}")


def _merged(spans):
    """Overlapping or touching spans of several blocks as one ascending list."""
    ordered = F.array_sort(F.array_distinct(spans))
    kind = "array<struct<first:long,last:long>>"
    return F.aggregate(ordered, F.array().cast(kind), lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["last"] >= s["first"]),
        F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["first"].alias("first"),
            F.greatest(F.element_at(done, -1)["last"], s["last"]).alias("last"))))
    ).otherwise(F.concat(done, F.array(s))).cast(kind))


def find_evaluation_items(proposals: DataFrame, items: DataFrame, id: str = "ID_PROPOSTA",
                          text: str = "OBJETO_PROPOSTA", item_id: str = "item_id", item_text: str = "text",
                          window: int = WINDOW, coverage: int = COVERAGE,
                          block_words: int = BLOCK_WORDS) -> DataFrame:
    """Where proposal texts repeat evaluation items.

    The reference has no evaluation items, so ``items`` is any table with an id and a text.
    Returns one row per proposal row: ``id``, ``tag`` (xxhash64 of the text), ``n_words``, ``spans`` (word positions [first, last)
    inside occurrences of an item's window of ``window`` consecutive words; an item with fewer
    words is one window), ``items`` (sorted ids, as strings, of items with an occurring window),
    ``n_hit`` and ``contaminated`` (some word is hit and ``coverage * n_hit >= n_words``).

    Items are taken in blocks of about ``block_words`` words; each block becomes one automaton,
    which is broadcast, and all texts are streamed against every block.  Null and empty texts and
    items have no words.  An item with a null id is searched for, but not listed.
    """
    spark = proposals.sparkSession
    items = items.select(F.col(item_id).cast("string").alias("item"), text_or_empty(item_text).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // (4 * block_words)))
    rows = proposals.select(F.col(id), F.xxhash64(text_or_empty(text)).alias("tag"), text_or_empty(text).alias("body"))

    def block(k: int) -> list[tuple]:
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        return [(r.item, r.text.encode("utf-8")) for r in part.collect()]

    if blocks == 1:
        found = _search_block(rows, block(0), window)
    else:
        # Rows of the same id and text have the same result in every block.
        parts = None
        for k in range(blocks):
            part = _search_block(rows, block(k), window)
            parts = part if parts is None else parts.unionByName(part)
        found = (parts.groupBy(id, "tag").agg(
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
            .withColumn("spans", _merged(F.col("spans"))).withColumn("items", F.array_sort(F.array_distinct("items"))))
        keys = rows.select(F.col(id).alias("key"), F.col("tag").alias("same"))
        found = (keys.join(found, F.col("key").eqNullSafe(F.col(id)) & (F.col("same") == F.col("tag")))
                 .select(id, "tag", "n_words", "spans", "items"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return (found.withColumn("n_hit", hit)
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words"))))
