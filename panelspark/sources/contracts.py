"""Column contracts: exact names, exact order, fail loudly."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T


class ContractError(ValueError):
    """An input does not have the columns, sheets or values its contract promises."""


@dataclass(frozen=True)
class Contract:
    """An ordered list of column names with the type each is cast to after landing."""

    name: str
    fields: tuple[str, ...]
    types: dict[str, str] = field(default_factory=dict)

    def check(self, observed: Sequence[str]) -> None:
        observed = tuple(observed)
        if observed == self.fields:
            return
        missing = sorted(set(self.fields) - set(observed))
        unexpected = sorted(set(observed) - set(self.fields))
        raise ContractError(
            f"{self.name}: columns differ from the contract; missing={missing}, "
            f"unexpected={unexpected}, only_order_differs={not missing and not unexpected}"
        )

    def landing_schema(self) -> T.StructType:
        """All columns as text: codes must never be inferred as numbers."""
        return T.StructType([T.StructField(name, T.StringType(), True) for name in self.fields])

    def typed_schema(self) -> T.StructType:
        ddl = ", ".join(f"`{n}` {self.types.get(n, 'string')}" for n in self.fields)
        return T.StructType.fromDDL(ddl)

    def fingerprint(self) -> str:
        body = json.dumps({"fields": self.fields, "types": self.types}, sort_keys=True,
                          ensure_ascii=False)
        return hashlib.sha256(body.encode("utf-8")).hexdigest()


def check_prefix_and_years(columns: Sequence[str], prefix: Sequence[str], years: Iterable[int],
                           year_prefix: str = "y") -> list[str]:
    """Check a wide panel: fixed leading columns, then exactly one column per expected year."""
    columns, prefix = list(columns), list(prefix)
    expected = [f"{year_prefix}{year}" for year in years]
    if columns[: len(prefix)] != prefix:
        raise ContractError(f"leading columns changed: {columns[: len(prefix)]}")
    found = [c for c in columns[len(prefix):]
             if c.startswith(year_prefix) and c[len(year_prefix):].isdigit()
             and len(c) == len(year_prefix) + 4]
    if found != expected:
        raise ContractError(f"year columns {found} differ from {expected}")
    if extra := sorted(set(columns) - set(prefix) - set(found)):
        raise ContractError(f"unknown columns: {extra}")
    return found


def pick_case_insensitive(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Select ``{target: source}``, finding each source header whatever its case or padding."""
    by_folded = {name.strip().casefold(): name for name in df.columns}
    missing = [s for s in wanted.values() if s.casefold() not in by_folded]
    if missing:
        raise ContractError(f"expected columns are missing: {missing}")
    return df.select(*[F.trim(F.col(f"`{by_folded[s.casefold()]}`").cast("string")).alias(t)
                       for t, s in wanted.items()])


def project(columns: Iterable[tuple[Column, str]]) -> list[Column]:
    return [column.alias(name) for column, name in columns]


def require(column: Column, path: str) -> Column:
    """The column, or a run-time error naming ``path`` where it is null."""
    return F.when(column.isNotNull(), column).otherwise(
        F.raise_error(F.lit(f"required value missing: {path}")))


def with_lineage(df: DataFrame, **stamps) -> DataFrame:
    """Add the same provenance constants to every row."""
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in stamps.items()})
