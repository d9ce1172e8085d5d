"""Unit search: normalised substring with a state shortcut, and exact resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.functions.text import normalize_search


def _query(spark: SparkSession, text: str) -> str:
    return spark.range(1).select(normalize_search(F.lit(text.strip())).alias("q")).first().q


def search_units(index: DataFrame, query: str, name: str = "municipio", state: str = "uf",
                 code: str = "codigo_ibge", position: str | None = None, limit: int = 50) -> DataFrame:
    """Units matching a typed query, in source order, at most ``limit`` of them.

    A two-letter query equal to a known state code lists that state; a query shorter than two
    characters finds nothing; any other query is a substring of name, state and code.
    """
    wanted = _query(index.sparkSession, query)
    order = position or "__position"
    if len(wanted) < 2:
        return index.limit(0)
    entries = index if position else index.withColumn(order, F.monotonically_increasing_id())
    in_state = F.lower(state) == wanted
    if len(wanted) == 2 and not entries.filter(in_state).isEmpty():
        found = entries.filter(in_state)
    else:
        text = normalize_search(F.concat_ws(" ", F.col(name), F.col(state), F.col(code)))
        found = entries.filter(text.contains(wanted))
    return found.orderBy(order).limit(limit).select(*index.columns)


def exact_matches(index: DataFrame, query: str | Column, name: str = "municipio",
                  state: str = "uf", code: str = "codigo_ibge") -> DataFrame:
    """Units whose code, name or "name, UF" equals the query after normalisation."""
    wanted = F.lit(_query(index.sparkSession, query)) if isinstance(query, str) else query
    forms = (F.col(code), F.col(name), F.concat(F.col(name), F.lit(", "), F.col(state)))
    condition = F.lit(False)
    for form in forms:
        condition = condition | (normalize_search(form) == wanted)
    return index.filter(condition)


def resolve_queries(index: DataFrame, queries: DataFrame, query: str, name: str = "municipio",
                    state: str = "uf", code: str = "codigo_ibge") -> DataFrame:
    """Resolve a table of queries: the unit's code where exactly one unit matches, else null."""
    forms = F.explode(F.array_distinct(F.array(*[normalize_search(f) for f in (
        F.col(code), F.col(name), F.concat(F.col(name), F.lit(", "), F.col(state)))])))
    known = index.select(F.col(code).alias("__code"), forms.alias("__form"))
    per_form = known.groupBy("__form").agg(F.count("*").alias("matches"), F.min("__code").alias("__code"))
    asked = queries.withColumn("__form", normalize_search(F.trim(query)))
    joined = asked.join(per_form, "__form", "left")
    return joined.withColumn("resolved", F.when(F.col("matches") == 1, F.col("__code"))).withColumn(
        "matches", F.coalesce("matches", F.lit(0))).drop("__form", "__code")
