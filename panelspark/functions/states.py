"""Algebra of survey answer states and section states (missing, undefined and zero differ)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from panelspark.functions.text import fold

# Accepted survey answers (folded) and the state each stands for.
ANSWERS = {
    "sim": "declared_yes",
    "nao": "declared_no",
    "recusa": "refused",
    "nao informou": "not_reported",
    "-": "not_applicable",
}
SOURCE_STATES = ("declared_yes", "declared_no", "refused", "not_reported", "not_applicable",
                 "unknown")
GOLD_STATES = SOURCE_STATES + ("not_in_source",)
SECTION_STATES = ("record", "no_record", "no_coverage", "not_published",
                  "not_in_legacy_universe", "not_in_source")


def lookup(column: Column, mapping: dict, what: str) -> Column:
    """Map a code to its label; an unknown code stops the job."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), column)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(
        F.concat(F.lit(f"{what} not recognised: "), F.coalesce(column.cast("string"), F.lit("null")))))


def answer_state(column: Column) -> Column:
    """A survey answer as a state, blind to case and accents."""
    folded = fold(F.trim(F.coalesce(column.cast("string"), F.lit(""))))
    return lookup(folded, ANSWERS, "survey answer")


def combine_states(states: Column) -> Column:
    """One state for several answers: any yes wins, a unanimous no is no, then by precedence."""
    combined = F.when(F.array_contains(states, "declared_yes"), "declared_yes")
    combined = combined.when((F.size(states) > 0) &
                             F.forall(states, lambda s: s == "declared_no"), "declared_no")
    for state in ("refused", "not_reported", "unknown"):
        combined = combined.when(F.array_contains(states, state), state)
    return combined.otherwise("not_applicable")


def override_state(state: Column, unknown_flag: Column) -> Column:
    """A yes in the 'does not know' question overrides the answer itself."""
    return F.when(unknown_flag == "declared_yes", "unknown").otherwise(state)


def events_state(count: Column) -> Column:
    return F.when(count > 0, "record").otherwise("no_record")


def coverage_state(row_count: Column) -> Column:
    return F.when(F.coalesce(row_count, F.lit(0)) > 0, "record").otherwise("no_coverage")


def published_state(in_universe: Column, *values: Column) -> Column:
    """Outside the universe, inside without a value, or a record."""
    absent = F.lit(False)
    for value in values:
        absent = absent | value.isNull()
    return (F.when(~F.coalesce(in_universe, F.lit(False)), "not_in_legacy_universe")
            .when(absent, "not_published").otherwise("record"))


def optional_state(in_universe: Column, value: Column) -> Column:
    return (F.when(~F.coalesce(in_universe, F.lit(False)), "not_in_legacy_universe")
            .when(value.isNull(), "no_record").otherwise("record"))


def source_state(in_source: Column) -> Column:
    return F.when(in_source, "record").otherwise("not_in_source")
