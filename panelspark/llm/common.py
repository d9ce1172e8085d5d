"""Helpers shared by the operators: driver tables, batches of whole texts, groups of linked ids."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.session import cut_lineage

ROUNDS = 60
FILTER_BITS = 1 << 26
FILTER_CHUNKS = 1024


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one is set only where the session has none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            cut_lineage(spark.range(1))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get()
    return folder.rstrip("/")


def stage_table(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: a cut of lineage with known size."""
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def map_texts(df: DataFrame, fn: Callable[[list], dict[str, list]], schema: str) -> DataFrame:
    """Apply ``fn`` to the whole texts of every Arrow batch of a two-column frame (id, text).

    ``fn`` gets a list of UTF-8 byte strings and returns lists by column name, one value per
    text; the id column is passed through.
    """
    key = df.columns[0]
    first = f"`{key}` {df.schema[0].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch.column(1).cast(pa.large_binary()).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(v if isinstance(v, pa.Array) else pa.array(v) for v in out.values())],
                    names=[key, *out])

    return df.mapInArrow(run, f"{first}, {schema}")


def append_columns(df: DataFrame, text: str, fn: Callable[[list], dict[str, list]], schema: str) -> DataFrame:
    """All columns of ``df``, and those that ``fn`` makes of the whole texts (null: empty) of each batch."""
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn([t or b"" for t in batch.column(place).cast(pa.large_binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v) for v in out.values())],
                                                 names=[*batch.schema.names, *out])

    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{held}, {schema}")


def _slots(values: np.ndarray) -> np.ndarray:
    """Two places in a filter for each 64-bit value."""
    shift = np.uint64(64 - FILTER_BITS.bit_length() + 1)
    lead = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return np.stack([lead >> shift, (lead * np.uint64(0x94D049BB133111EB)) >> shift]).astype(np.int64)


def fixed_filter(values: DataFrame) -> bytes:
    """A filter of fixed size that passes every value of a one-column frame of longs.

    It only saves moving rows that cannot matter: a wrong pass costs work and never changes a result,
    and the filter passes more as it fills up on more data.  Tasks send their bits, never values;
    bits meet in two steps, so that what one task reads is bounded by the tasks of a share of them.
    """
    chunk_bits = FILTER_BITS // FILTER_CHUNKS

    def mark(batches):
        bits, share = np.zeros(FILTER_BITS, bool), TaskContext.get().partitionId() % 64
        for batch in batches:
            found = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bits[_slots(found).ravel()] = True
        parts = bits.reshape(FILTER_CHUNKS, chunk_bits)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(np.full(len(used), share), pa.int32()),
             pa.array([np.packbits(parts[c]).tobytes() for c in used], pa.binary())], names=["chunk", "share", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        bits = np.zeros(chunk_bits // 8, np.uint8)
        for blob in table.column("bits").to_pylist():
            bits |= np.frombuffer(blob, np.uint8)
        return table.slice(0, 1).set_column(2, "bits", pa.array([bits.tobytes()], pa.binary()))

    schema = "chunk int, share int, bits binary"
    marked = values.mapInArrow(mark, schema)
    for keys in (["chunk", "share"], ["chunk"]):
        marked = marked.groupBy(*keys).applyInArrow(merge, schema)
    held = bytearray(FILTER_BITS // 8)
    for row in marked.collect():
        at = row.chunk * chunk_bits // 8
        held[at:at + len(row.bits)] = row.bits
    return bytes(held)


def filter_passes(values: np.ndarray, held: bytes) -> np.ndarray:
    """Which unsigned 64-bit values a filter passes."""
    table = np.frombuffer(held, np.uint8)
    one, two = ((table[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 for s in _slots(values))
    return (one & two) == 1


def components(links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the smallest node it can reach.

    Alternates large-star and small-star rounds, which halve path lengths, so a chain of n nodes
    takes about log n rounds.  Neighbourhoods are only ever reduced to their minimum (with map-side
    partial aggregation), never gathered.  Minima are written to the checkpoint folder before they
    are joined, so that both sides of a join are plain exchanges and a node with very many links is
    split among tasks.
    Null ends are ignored; loops and repeated links are harmless.
    """
    a, b = F.col("a"), F.col("b")
    edges = cut_lineage(links.filter(a.isNotNull() & b.isNotNull() & (a != b))
                        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    for _ in range(rounds):
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        low = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), a).alias("low")))
        # Larger neighbours of each node move to the smallest node around it.
        large = cut_lineage(edges.select(b.alias("a"), a.alias("up")).join(low, "a")
                            .select(F.col("up").alias("a"), F.col("low").alias("b")).filter(a != b).distinct())
        # Smaller neighbours and the node itself move to the smallest one.
        low = cut_lineage(large.groupBy("a").agg(F.min("b").alias("low")))
        small = (large.join(low, "a")
                 .select(F.explode(F.array(F.struct(a.alias("a"), F.col("low").alias("b")),
                                           F.struct(b.alias("a"), F.col("low").alias("b")))).alias("e"))
                 .select("e.a", "e.b").filter(a != b).distinct())
        after = cut_lineage(small)
        moved = after.join(edges, ["a", "b"], "left_anti").limit(1).count()
        edges = after
        # Stars only: no root of one link is the leaf of another, and nothing moved.
        if not moved:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(b.alias("node"), b.alias("root")).distinct()
    return edges.select(a.alias("node"), b.alias("root")).unionByName(roots)


_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, lower-cased in A-Z."""
    return (text or b"").translate(_WORD).split()


_WORD_OR_BREAK = bytes(10 if c == 10 else held for c, held in enumerate(_WORD))


def lines_of(text: bytes | None) -> list[bytes]:
    """The words, apart by one blank, of every line of a text; an empty text has no line."""
    return [b" ".join(line.split()) for line in text.translate(_WORD_OR_BREAK).split(b"\n")] if text else []


def labelled_sample(texts: DataFrame, labels: DataFrame, id: str, text: str, label: str, limit: int) -> DataFrame:
    """(text, label) of about ``limit`` labelled rows at most, chosen by a hash of the id.

    An id with several labels counts once, with the larger one.  The chosen labels are bounded by
    ``limit``, so they are broadcast and the texts are filtered where they lie.
    """
    usable = (labels.filter(F.col(id).isNotNull() & F.col(label).isin(0, 1))
              .groupBy(F.col(id).alias("labelled")).agg(F.max(label).alias(label)))
    held = usable.count()
    parts = 1 << 30
    chosen = F.pmod(F.xxhash64("labelled"), F.lit(parts)) < int(parts * min(1.0, limit / max(1, held)))
    rows = texts.select(F.col(id).alias("labelled"), F.col(text))
    return rows.join(F.broadcast(usable.filter(chosen)), "labelled").select(text, label)
