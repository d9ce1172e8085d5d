"""Number, date and ratio helpers with explicit missingness."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def percentage(part: Column, whole: Column) -> Column:
    """``part / whole * 100``; null where the whole is zero or either side is null."""
    return part / F.nullif(whole, F.lit(0)) * 100.0


def pct_change(now: Column, base: Column) -> Column:
    return percentage(now - base, base)


def strict_count(column: Column) -> Column:
    """A trimmed integer; a bad or empty value stops the job."""
    return F.trim(column).cast("bigint")


def strict_money(column: Column) -> Column:
    return F.trim(column).cast("decimal(38,2)")


def lenient(column: Column, type_name: str) -> Column:
    """A cast that gives null instead of an error; blank is null."""
    return F.nullif(F.trim(column), F.lit("")).try_cast(type_name)


def lenient_int(column: Column) -> Column:
    """Comma or point decimals rounded half to even; anything unusable is 0."""
    number = F.replace(column.cast("string"), F.lit(","), F.lit(".")).try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(9.0e18))
    return F.when(finite, F.rint(number).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def locale_decimal(column: Column) -> Column:
    """``1.234,56`` as a double rounded to cents; null when it is not a number."""
    plain = F.replace(F.replace(column, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.round(F.nullif(plain, F.lit("")).try_cast("double"), 2)


def numeric_text(column: Column) -> Column:
    """A plain non-negative decimal literal as a double; null for any other text."""
    return F.when(column.rlike(r"\A\d+(?:\.\d+)?\z"), column.try_cast("double"))


def complement_pct(value: Column) -> Column:
    return F.round(F.lit(100.0) - value, 2)


def serial_to_date(column: Column) -> Column:
    """Workbook day number (days since 1899-12-30) to a date; null when unusable."""
    days = F.floor(column.try_cast("double")).try_cast("int")
    return F.date_add(F.lit("1899-12-30").cast("date"), days)


def parse_day(column: Column) -> Column:
    """``d/M/yyyy`` with or without leading zeros; a bad date stops the job."""
    return F.to_date(F.trim(column), "d/M/yyyy")


def years_before(day: Column, years: int) -> Column:
    return F.add_months(day, -12 * years)


def in_trailing_years(day: Column, reference: Column, years: int) -> Column:
    """Strictly after ``reference`` minus n years (the lower bound itself is outside)."""
    return day > years_before(reference, years)


def area_km2(hectares: Column) -> Column:
    return hectares / 100.0


def json_number(column: Column) -> Column:
    """Reject non-finite doubles before they are encoded."""
    bad = F.isnan(column) | (F.abs(column) == F.lit(float("inf")))
    return F.when(column.isNull() | ~bad, column).otherwise(
        F.raise_error(F.lit("non-finite number in a published document")))
