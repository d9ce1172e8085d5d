"""Repeated passages of proposal texts: hashed units, of which the earliest occurrence stays."""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from panelspark.llm.common import stage_table, text_or_empty, words_of
from panelspark.session import cut_lineage

#: The sentences of each line, since passages are pasted inside lines.
UNIT = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")
LINE = re.compile(r"[^\n]*\n|[^\n]+")
PARAGRAPH = re.compile(r"(?:[^\n]|\n(?!\n))+\n*|\n+")
LEAST_WORDS = 5


def units_of(text: str, unit: re.Pattern, least_words: int) -> list[tuple[int, int, bytes | None]]:
    """(start, end, digest) of every unit in characters; no digest for a unit too short to judge."""
    out = []
    for match in unit.finditer(text):
        words = words_of(match.group().encode("utf-8", "replace"))
        digest = xxhash.xxh3_128_digest(b" ".join(words)) if len(words) >= least_words else None
        out.append((*match.span(), digest))
    return out


def lines_of(text: str) -> list[tuple[int, int, bytes | None]]:
    """(start, end, digest) of every line, with its break, in characters; no digest for a line without words."""
    return [(a, b, digest and b"line" + digest) for a, b, digest in units_of(text, LINE, 1)]


def kept_text(text: str | Column, removed: str | Column) -> Column:
    """A text without its removed spans (ascending, apart)."""
    text, removed = (F.col(c) if isinstance(c, str) else c for c in (text, removed))
    end = F.array(F.struct(F.length(text).cast("long").alias("start"), F.length(text).cast("long").alias("end")))
    spans = F.concat(removed, end)
    start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(spans, start, lambda done, s: F.struct(
        F.concat(done["kept"], text.substr((done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))).alias("kept"),
        s["end"].alias("at")))["kept"]


def repeated_passages(proposals: DataFrame, id: str = "ID_PROPOSTA", text: str = "OBJETO_PROPOSTA",
                      unit: re.Pattern = UNIT, least_words: int = LEAST_WORDS, whole_lines: bool = False) -> DataFrame:
    """Units of proposal texts that repeat an earlier one, with their original offsets.

    Texts are cut into units (by default the sentences of each line, with what ends them; pass
    ``PARAGRAPH`` for paragraphs); units are normalised to their words, lower-cased in A-Z.  Of equal
    units of at least ``least_words`` words the one with the smallest (id, start) stays and the rest
    are removed; shorter units always stay.  With ``whole_lines`` each line that has words, of any
    length, is a unit beside these: a line that repeats an earlier line goes as a whole, its break with it.
    Such units count in ``n_units`` and ``n_removed``, each character once in ``chars_removed``.  Returns one row per row: ``id``, ``n_units``,
    ``n_removed``, ``chars_removed`` and ``removed``, an ascending array of spans (start, end) in
    characters of the original text, joined where they touch.  :func:`kept_text` applies them.

    Null and empty texts have no units.  Rows with equal id and text are one document; rows that
    share an id only are ranked by their text's hash.  Null ids rank first.

    Digests (128 bits) are reduced to their earliest occurrence with partial aggregation, so a unit
    found in a third of all rows is one row per task; only repeated digests meet the units again.
    """
    def cut(batches):
        for batch in batches:
            keys, starts, ends, digests, tags = [], [], [], [], []
            texts = batch.column(1).to_pylist()
            for i, body in enumerate(texts):
                found = units_of(body, unit, least_words) + (lines_of(body) if whole_lines else [])
                tag = xxhash.xxh64_intdigest(body.encode("utf-8", "replace")) >> 1
                # The row without a digest stands for the text itself.
                for start, end, digest in [(0, len(found), None), *(u for u in found if u[2])]:
                    keys.append(i)
                    starts.append(start)
                    ends.append(end)
                    digests.append(digest)
                    tags.append(tag)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(tags, pa.int64()), pa.array(starts, pa.int64()),
                 pa.array(ends, pa.int64()), pa.array(digests, pa.binary())], names=["id", "tag", "start", "end", "digest"])

    rows = proposals.select(F.col(id).alias("id"), text_or_empty(text).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    units = stage_table(rows.mapInArrow(cut, f"id {kind}, tag long, start long, end long, digest binary"))
    place = F.struct("id", "tag", "start")
    first = (units.filter("digest IS NOT NULL").groupBy("digest")
             .agg(F.min(place).alias("first"), F.max(place).alias("last"))
             .filter("first <> last").select("digest", "first"))
    spans = (units.filter("digest IS NOT NULL").join(first, "digest").filter(place != F.col("first"))
             .select("id", "tag", F.struct("start", "end").alias("span")))
    # One row per document: its unit count, and the spans to remove.
    per_doc = cut_lineage(spans.groupBy("id", "tag").agg(F.array_sort(F.collect_set("span")).alias("spans"))
                          .withColumnsRenamed({"id": "doc", "tag": "same"}))
    kind = "array<struct<start:bigint,end:bigint>>"
    joined = F.aggregate("spans", F.array().cast(kind), lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
        F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(s))).cast(kind))
    docs = units.filter("digest IS NULL").select("id", "tag", F.col("end").alias("n_units"))
    out = docs.join(per_doc, F.col("id").eqNullSafe(F.col("doc")) & (F.col("tag") == F.col("same")), "left")
    spans = F.coalesce("spans", F.array().cast(kind))
    return out.select(
        F.col("id").alias(id), "n_units", F.size(spans).cast("long").alias("n_removed"),
        F.aggregate(F.coalesce(joined, F.array().cast(kind)), F.lit(0).cast("long"),
                    lambda n, s: n + s["end"] - s["start"]).alias("chars_removed"),
        F.coalesce(joined, F.array().cast(kind)).alias("removed"))
