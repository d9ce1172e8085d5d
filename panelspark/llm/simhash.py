"""SimHash near duplicates of proposal texts, linked through pigeonring-filtered candidates.

A 64-bit fingerprint is cut into a ring of three segments.  If two fingerprints differ in at most
two bits, then some segment starts a chain whose cumulative differences stay within the
proportional budget at every length: nothing over one segment (floor(2/3)), at most one bit over
two (floor(4/3)), at most two over all three.  The first two links of the chain are turned into
keys (the first segment exactly, and one half of the second, since at most one half can differ);
the last is the full check.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import append_columns, components, text_or_empty
from panelspark.llm.hamming import BUCKET, close_pairs, mask_of
from panelspark.session import cut_lineage

SEED = 42
WORDS = 3
DISTANCE = 2

_LOWER = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_PIECE = 1 << 15


def fingerprints(texts: list[bytes | None], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """SimHash of each text as signed 64-bit integers; a text without words has fingerprint 0."""
    digest, out = xxhash.xxh64_intdigest, np.zeros(len(texts), dtype=np.uint64)
    for i, text in enumerate(texts):
        tokens = (text or b"").translate(_LOWER).split()
        if not tokens:
            continue
        n = max(1, len(tokens) - words + 1)
        counts = np.zeros(64, dtype=np.int64)
        for lo in range(0, n, _PIECE):
            piece = tokens[lo:lo + _PIECE + words - 1]
            grams = zip(*(piece[k:] for k in range(words))) if len(piece) >= words else (piece,)
            h = np.array([digest(b" ".join(g), seed) for g in grams], dtype="<u8")
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]
    return out.view(np.int64)


def ring_masks() -> list[int]:
    """Bits that must agree: one segment of the ring and either half of the next one."""
    segments = [list(range(0, 22)), list(range(22, 43)), list(range(43, 64))]
    masks = []
    for i, segment in enumerate(segments):
        following = segments[(i + 1) % 3]
        half = len(following) // 2
        masks += [mask_of(segment + following[:half]), mask_of(segment + following[half:])]
    return masks


def link_similar_proposals(proposals: DataFrame, id: str = "ID_PROPOSTA", text: str = "OBJETO_PROPOSTA",
                           bucket: int = BUCKET) -> DataFrame:
    """Fingerprint and group of near-identical objects for every transfer proposal.

    Returns one row per input row: ``id``, ``tag`` (xxhash64 of the text), ``fingerprint`` (signed
    64-bit), ``component`` (the smallest id reachable over links of at most two differing bits, its
    own included).

    Texts are lower-cased in A-Z, cut into words at ASCII white space and into three-word shingles
    (repeats count, fewer words make one shingle).  Null and empty texts have fingerprint 0 and are
    linked like any other.  Rows that repeat an id are all returned, each judged by its own text.  A row with a null id takes the
    group of its fingerprint (null if no other row has one).  Other columns are ignored.
    """
    rows = proposals.select(F.col(id).alias("node"), text_or_empty(text).alias("body"))
    # Few bytes per row leave this stage; everything after works on them.
    rows = append_columns(rows, "body", lambda texts: {"fp": fingerprints(texts)}, "fp long")
    rows = cut_lineage(rows.select("node", "fp", F.xxhash64("body").alias("tag")))
    prints = cut_lineage(rows.groupBy("fp").agg(F.min("node").alias("node")))
    # Large buckets are cut by two of four parts of their open bits: 32, 16, then 8 open bits.
    links = close_pairs(prints.select("fp"), DISTANCE, ring_masks(), parts=4, levels=3, bucket=bucket)
    groups = (prints.join(components(links).withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", "node", F.coalesce("root", "fp").alias("root")))
    least = groups.groupBy("root").agg(F.min("node").alias("component"))
    groups = groups.join(least, "root").select("fp", "component")
    return rows.join(groups, "fp").select(F.col("node").alias(id), "tag", F.col("fp").alias("fingerprint"), "component")
