"""Key-based comparisons: match flags, set differences, duplicates, dedup, latest row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def left_with_match(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
                    flag: str = "is_match", carry: Sequence[str] = ()) -> DataFrame:
    """Every fact row with a flag telling whether its unit exists in the dimension."""
    side = dim.select(F.col(dim_key).alias("__key"), F.lit(True).alias("__hit"),
                      *[F.col(c) for c in carry])
    joined = fact.join(side, F.col(fact_key) == F.col("__key"), "left")
    return joined.withColumn(flag, F.coalesce(F.col("__hit"), F.lit(False))).drop("__key", "__hit")


def only_in_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks.

    Keys are made distinct first (partial aggregation), so a hot key costs one row.
    """
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def in_both(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_semi")


def key_comparison(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every distinct key of either side with ``in_left`` and ``in_right``."""
    marks = (left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r"))
             .unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))))
    return marks.groupBy(*keys).agg((F.max("l") == 1).alias("in_left"),
                                    (F.max("r") == 1).alias("in_right"))


def key_comparison_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: distinct keys left, right, in both, only left, only right."""
    both = F.col("in_left") & F.col("in_right")
    return key_comparison(left, right, keys).agg(
        F.count_if(F.col("in_left")).alias("left_keys"),
        F.count_if(F.col("in_right")).alias("right_keys"),
        F.count_if(both).alias("matched_keys"),
        F.count_if(F.col("in_left") & ~F.col("in_right")).alias("left_only"),
        F.count_if(~F.col("in_left") & F.col("in_right")).alias("right_only"))


def is_subset(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> bool:
    return only_in_left(left, right, keys).isEmpty()


def unused_members(dim: DataFrame, fact: DataFrame, key: str) -> DataFrame:
    """Dimension rows no fact row points at."""
    return dim.join(fact.select(key).distinct(), key, "left_anti")


def full_outer_with_flags(left: DataFrame, right: DataFrame, key: str, left_flag: str,
                          right_flag: str) -> DataFrame:
    """Full outer join on one key with the key coalesced and a presence flag for each side."""
    l = left.withColumn(left_flag, F.lit(True))
    r = right.withColumn(right_flag, F.lit(True))
    joined = l.join(r, key, "full")
    return joined.withColumns({flag: F.coalesce(F.col(flag), F.lit(False))
                               for flag in (left_flag, right_flag)})


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def dependency_violations(df: DataFrame, key: Sequence[str], dependent: Sequence[str]) -> DataFrame:
    """Keys that do not have exactly one value of the dependent columns (nulls count as values)."""
    pairs = df.groupBy(*key, *dependent).agg(F.lit(1).alias("one"))
    return pairs.groupBy(*key).agg(F.count("one").alias("values")).filter(F.col("values") != 1)


def first_seen(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The earliest row of each key.  An aggregate, not a window: partial results per task."""
    return _pick(df, keys, F.min_by, F.col(seq))


def last_wins(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The last row of each key in arrival order."""
    return _pick(df, keys, F.max_by, F.col(seq))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` tuple; give the arrival number last to break ties."""
    return _pick(df, keys, F.max_by, F.struct(*order))


def _pick(df: DataFrame, keys: Sequence[str], choose, order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(choose(F.struct(*rest), order).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def compare_copies(left: DataFrame, right: DataFrame, key: str,
                   comparators: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Typed comparison of two copies of a table.

    ``comparators`` maps a field to its normalised left and right expressions, written over
    columns ``l.<name>`` and ``r.<name>``.  One row per common key and distinct content: one
    boolean per field (null-safe), ``all_fields_match`` and ``pairs``, the number of row pairs it
    stands for (1 where the key is unique on both sides).  Equal rows are merged before the join,
    so a key repeated on both sides does not multiply.
    """
    fields = {name: f"f{i}" for i, name in enumerate(comparators)}

    def side(df: DataFrame, alias: str, index: int) -> DataFrame:
        typed = df.alias(alias).select(F.col(f"{alias}.{key}").alias("__key"), *[
            pair[index].alias(f"{alias}_{fields[name]}") for name, pair in comparators.items()])
        return typed.groupBy(*typed.columns).agg(F.count("*").alias(f"{alias}_n"))

    joined = side(left, "l", 0).join(side(right, "r", 1), "__key")
    flags = {name: F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")) for name, f in fields.items()}
    return joined.select(F.col("__key").alias(key),
                         *[c.alias(f"{name}_matches") for name, c in flags.items()],
                         reduce(lambda a, b: a & b, flags.values()).alias("all_fields_match"),
                         (F.col("l_n") * F.col("r_n")).alias("pairs"))


def mismatch_counts(compared: DataFrame) -> DataFrame:
    """Mismatching row pairs per field of ``compare_copies`` output, plus compared and differing."""
    fields = [c for c in compared.columns if c.endswith("_matches")]
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("pairs"))), F.lit(0))
    return compared.agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("compared_rows"),
        count(~F.col("all_fields_match")).alias("differing_rows"),
        *[count(~F.col(f"`{c}`")).alias(c.replace("_matches", "_differences")) for c in fields])


def counter_entries(df: DataFrame, key: Sequence[str], label: str, name: str,
                    by_count: bool = True) -> DataFrame:
    """Per key an ordered array of (label, n): by descending count then label, or by label."""
    counted = df.filter(F.col(label).isNotNull()).groupBy(*key, label).agg(F.count("*").alias("n"))
    entry = (F.struct((-F.col("n")).alias("order"), F.col(label).alias("label"), F.col("n"))
             if by_count else F.struct(F.col(label).alias("label"), F.col("n")))
    return counted.groupBy(*key).agg(
        F.transform(F.sort_array(F.collect_list(entry)),
                    lambda e: F.struct(e["label"].alias("label"), e["n"].alias("n"))).alias(name))


def union_of_lists(df: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """Sorted distinct union of an array column per key; elements are made distinct map-side."""
    items = df.select(*key, F.explode(column).alias("__item")).distinct()
    return items.groupBy(*key).agg(F.sort_array(F.collect_list("__item")).alias(column))


def sorted_distinct(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sorted distinct value list of each column per key, and null-free."""
    return df.groupBy(*key).agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns])
