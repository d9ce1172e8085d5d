"""Registry of queries over the driver tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table.  Its schema is read from the file footer once per path, not per use."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


# The driver tables in the roles of the library: customers are units inside nations, orders are
# dated events of five types, line items are a supplier x class x year panel.

FLAGGED = ("1-URGENT", "2-HIGH", "3-MEDIUM")
TYPES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def units(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("unit"), F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("region"), F.col("c_mktsegment").alias("state"))


def events(spark, folder) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("unit"), day.alias("day"),
        F.year(day).alias("year"), F.month(day).alias("month"),
        F.col("o_orderpriority").alias("type"),
        F.col("o_orderpriority").isin(*FLAGGED).alias("flagged"),
        (F.col("o_orderstatus") == "F").alias("recognized"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))


def panel(spark, folder) -> DataFrame:
    """Supplier x group x class x year with a quantity as area (whole numbers, so sums are exact)."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("unit"), F.col("l_linestatus").alias("biome"),
        F.col("l_returnflag").alias("class_id"), F.year("l_shipdate").alias("year"),
        F.col("l_quantity").alias("area"))


def panel_years(rows: DataFrame) -> list[int]:
    """The years of the panel; one row reaches the driver."""
    lo, hi = rows.agg(F.min("year"), F.max("year")).first()
    return list(range(lo, hi + 1))


def wide_panel(spark, folder) -> tuple[DataFrame, list[str]]:
    """The same panel with one column per year."""
    rows = panel(spark, folder)
    years = panel_years(rows)
    wide = rows.groupBy("unit", "biome", "class_id").agg(
        *[F.sum(F.when(F.col("year") == y, F.col("area"))).alias(f"y{y}") for y in years])
    return wide, [f"y{y}" for y in years]


def as_double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


U = "units AS (SELECT c_custkey AS unit, c_name AS name, c_nationkey AS region, c_mktsegment AS state FROM customer)"
E = """ev AS (SELECT o_orderkey AS event_id, o_custkey AS unit, CAST(o_orderdate AS DATE) AS day,
  CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, o_orderpriority AS type,
  o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM') AS flagged, o_orderstatus = 'F' AS recognized,
  o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders)"""
P = """panel AS (SELECT l_suppkey AS unit, l_linestatus AS biome, l_returnflag AS class_id,
  CAST(year(l_shipdate) AS INTEGER) AS year, l_quantity AS area FROM lineitem)"""
SNAP = """snap AS (SELECT unit, year, sum(area) FILTER (WHERE class_id <> 'N') AS mapped_area_ha,
  coalesce(sum(area) FILTER (WHERE class_id = 'R'), 0.0) AS urban_area_ha,
  coalesce(sum(area) FILTER (WHERE class_id IN ('A','N')), 0.0) AS native_area_ha
  FROM panel GROUP BY unit, year)"""
