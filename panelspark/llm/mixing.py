"""Mixing event narratives of several regions to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.llm.common import stage_table, text_or_empty

# Fixed values of the mix: weights by source in code point order, share of all words, most repeats.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
SEED = "mix-1"


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, source: str, weights=WEIGHTS, share: float = SHARE,
                   repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size).

    Shares follow the weights; a source stops at ``repeats`` times its size and the excess is
    shared again by weight until no source is above.  That end state is one common level: each
    source gets the smaller of its cap and its weight times the level.  The windows run over one
    row per source.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col(source).asc_nulls_last())
    by_cap = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col(source).asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    table = sizes.groupBy(source).agg(F.sum("size").alias("source_size"))
    pick = F.array(*[F.lit(float(w)) for w in weights])
    table = (table.withColumn("place", F.row_number().over(by_name))
             .withColumn("weight", F.element_at(pick, ((F.col("place") - 1) % len(weights) + 1).cast("int")))
             .withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
             .withColumn("wanted", F.sum("source_size").over(whole) * F.lit(share)))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    table = table.withColumn("level", (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                             / F.sum("weight").over(onward))
    # The level holds from the first source that stays below its cap.
    final = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(
        (F.col("cap") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(whole)["level"]
    table = table.withColumn("final", final)
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(
        F.least("cap", F.col("final") * F.col("weight")))
    return (table.withColumn("target", target)
            .withColumn("rate", F.when(F.col("source_size") == 0, 0.0)
                        .otherwise(F.least(F.col("target") / F.col("source_size"), F.lit(float(repeats)))))
            .select(source, "source_size", "target", "rate"))


def coin(id: str, seed: str = SEED) -> Column:
    """A number in [0, 1) fixed by the seed and the id (null: the text "null")."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))


def copies(id: str, rate: Column, seed: str = SEED) -> Column:
    """floor(rate) copies and one more with the probability of the fraction."""
    whole = F.floor(rate)
    return (whole + F.when(coin(id, seed) < rate - whole, 1).otherwise(0)).cast("int")


def mix_narratives(events: DataFrame, id: str = "Protocolo_S2iD", source: str = "regiao",
                   text: str = "DH_Descricao", weights=WEIGHTS, share: float = SHARE,
                   repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """How often each event's narrative enters a mix of regions, with the region's target.

    Returns one row per event: ``id``, ``size`` (words; null text: 0), ``source_size``, ``target``
    (words of the event's region in the mix), ``copies`` (0 to ``repeats``), ``taken`` (words).
    Regions are weighed in code point order, null last and a region of its own.  A region of no
    words has target 0.  Rows that repeat an id draw the same number; all null ids draw one number.
    Words are summed by region before anything moves, so a region holding most events is no hot key,
    and the table of regions (a fixed catalogue, one row each) is joined by its measured size.
    """
    sized = stage_table(events.select(F.col(id).alias("id"), F.col(source).alias("source"),
                                      word_count(text).alias("size")))
    targets = stage_table(source_targets(sized, "source", weights, share, repeats))
    joined = sized.join(targets.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")))
    return (joined.withColumn("copies", copies("id", F.col("rate"), seed))
            .select(F.col("id").alias(id), "size", "source_size", "target", "copies",
                    (F.col("size") * F.col("copies")).alias("taken")))


def emit_mix(events: DataFrame, id: str = "Protocolo_S2iD", source: str = "regiao",
             text: str = "DH_Descricao", weights=WEIGHTS, share: float = SHARE,
             repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """The mix itself: all columns of ``events`` with ``copy`` (from 1), one row per copy taken.

    Decisions as in :func:`mix_narratives`.  ``events`` must not have a column ``copy`` of its own;
    other columns pass through.  Whole rows never move: only the sums by region are shuffled.
    """
    sizes = events.select(F.col(source).alias("mix_source"), word_count(text).alias("size"))
    targets = stage_table(source_targets(sizes, "mix_source", weights, share, repeats)
                          .select("mix_source", F.col("rate").alias("mix_rate")))
    return (events.join(targets, F.col(source).eqNullSafe(F.col("mix_source")))
            .withColumn("copy", F.explode(F.when(
                F.col("mix_rate").isNotNull() & (copies(id, F.col("mix_rate"), seed) > 0),
                F.sequence(F.lit(1), copies(id, F.col("mix_rate"), seed)))))
            .drop("mix_source", "mix_rate"))
