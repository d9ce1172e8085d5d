"""Round trips through the library's readers and sinks, and decisions over releases.

Each query writes a driver table to the shared folder in the form a source would deliver, reads it
back with the library's reader and returns the rows, so that the SQL over the same table must agree.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelspark.operators import conform, profiles
from panelspark.operators.release import input_signature, is_unchanged, output_fingerprints, schema_change_rows
from panelspark.operators.shards import (document_overhead, entry_bytes, pack_shards, read_shard_documents,
                                         shard_documents, shard_name)
from panelspark.presets import events as ev, units as un
from panelspark.quality import checks as q
from panelspark.queries.registry import E, U, events, query, table, units
from panelspark.session import cut_lineage, scratch_path
from panelspark.sinks.writers import (append_run, archive_release, write_csv, write_json_lines, write_named_texts,
                                      write_ordered_parquet, write_parquet, write_slice)
from panelspark.sources.contracts import Contract, with_lineage
from panelspark.sources.readers import (file_inventory, latest_successful_run, read_contract_csv, read_landed_sheet,
                                        read_nested_json, read_range, read_runs, read_typed_csv, representative_sample, unzip_csv,
                                        with_source_row_number)

ORDERS = Contract("orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "day", "amount"),
                  {"o_orderkey": "bigint", "o_custkey": "bigint", "day": "date", "amount": "decimal(18,2)"})


def _orders(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))


_ORDERS_SQL = """SELECT {} FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) AS day,
  CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders)"""


@query("contract_csv", _ORDERS_SQL.format("CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, "
                                          "o_orderstatus, o_orderpriority, CAST(day AS VARCHAR) AS day, CAST(amount AS VARCHAR) AS amount"))
def contract_csv(spark, folder):
    """Strict delimited scan under a column contract: every column stays text."""
    path = scratch_path(spark, "contract-csv")
    write_csv(_orders(spark, folder), path, sep=";")
    return read_contract_csv(spark, path, ORDERS, multi_line=False)


@query("typed_csv", _ORDERS_SQL.format("*"))
def typed_csv(spark, folder):
    """Delimited scan with declared types, over the sink's own file."""
    path = scratch_path(spark, "typed-csv")
    write_csv(_orders(spark, folder), path)
    return read_typed_csv(spark, path, ORDERS)


@query("landed_sheet", """WITH box AS (SELECT min(o_orderkey) + (max(o_orderkey) - min(o_orderkey)) // 4 AS lo, max(o_orderkey) - (max(o_orderkey) - min(o_orderkey)) // 4 AS hi FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderkey BETWEEN lo AND hi AS in_box FROM orders, box""")
def landed_sheet(spark, folder):
    """All rows of a sheet landed as Parquet and read as text, marked where a box over the middle half of its keys holds them."""
    path = scratch_path(spark, "sheet")
    rows = _orders(spark, folder)
    write_parquet(rows, path, sort_by=["o_orderkey"])
    ends = rows.agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last")).first()
    quarter = (ends["last"] - ends["first"]) // 4
    sheet = read_landed_sheet(spark, path).withColumn("row", F.col("o_orderkey").cast("long"))
    box = read_range(sheet, ends["first"] + quarter, ends["last"] - quarter, ["o_orderkey"], "row")
    return (sheet.join(box.select("o_orderkey", F.lit(True).alias("held")), "o_orderkey", "left")
            .select("o_orderkey", "o_orderstatus", F.coalesce("held", F.lit(False)).alias("in_box")))


def _territory(spark, folder):
    """Customers as nested territory rows: a unit inside a region (nation), state (segment) and world region."""
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, folder, "region").select("r_regionkey", "r_name")
    rows = (table(spark, folder, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey")))
    place = lambda number, name, **more: F.struct(number.cast("long").alias("id"), name.alias("nome"),
                                                  *[v.alias(k) for k, v in more.items()])
    world = F.struct(F.col("r_regionkey").cast("long").alias("id"), F.substring("r_name", 1, 2).alias("sigla"), F.col("r_name").alias("nome"))
    state = F.struct(F.col("n_nationkey").cast("long").alias("id"), F.substring("n_name", 1, 2).alias("sigla"),
                     F.col("n_name").alias("nome"), world.alias("regiao"))
    wide = F.struct(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("nome"), state.alias("UF"))
    micro = F.when(F.col("c_custkey") % 5 != 0, place(F.col("c_nationkey"), F.col("n_name"), mesorregiao=place(F.col("n_regionkey"), F.col("r_name"))))
    return rows.select(
        F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("nome"), micro.alias("microrregiao"),
        F.struct(F.col("c_nationkey").cast("long").alias("id"), F.col("n_name").alias("nome"),
                 wide.alias("regiao-intermediaria")).alias("regiao-imediata"))


@query("conform_units", """SELECT CAST(c_custkey AS VARCHAR) AS codigo_ibge, c_name AS municipio, lower(c_name) AS municipio_normalized,
  n_name AS uf, substr(n_name, 1, 2) AS sigla_uf, CAST(n_nationkey AS VARCHAR) AS codigo_uf_ibge, r_name AS regiao,
  CASE WHEN c_custkey % 5 <> 0 THEN r_name END AS mesorregiao, CASE WHEN c_custkey = 7 THEN 'especial' ELSE 'municipio' END AS tipo_unidade_territorial,
  '2026' AS release FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def conform_units(spark, folder):
    """Nested JSON to the unit dimension: text codes, folded names, optional levels, an override, lineage."""
    path = scratch_path(spark, "territory")
    write_json_lines(_territory(spark, folder), path)
    raw = spark.read.schema(un.UNIT_SCHEMA).json(path)
    silver = conform.conform_units(raw, {"7": "especial"}, release="2026")
    return silver.select("codigo_ibge", "municipio", "municipio_normalized", "uf", "sigla_uf", "codigo_uf_ibge", "regiao",
                         "mesorregiao", "tipo_unidade_territorial", "release")


@query("nested_json", "SELECT c_custkey AS id, c_name AS nome, n_name AS estado FROM customer JOIN nation ON c_nationkey = n_nationkey")
def nested_json(spark, folder):
    """A JSON array of nested objects under an explicit schema."""
    path = scratch_path(spark, "array")
    rows = _territory(spark, folder).select(F.to_json(F.struct("*")).alias("line"), (F.col("id") % 8).alias("file"))
    arrays = rows.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("line"), ","), F.lit("]")).alias("body"))
    write_named_texts(arrays.select(F.concat("file", F.lit(".json")).alias("file"), "body"), path, "file", "body")
    return read_nested_json(spark, path, un.UNIT_SCHEMA).select(
        "id", "nome", F.col("`regiao-imediata`.`regiao-intermediaria`.UF.nome").alias("estado"))


_CODES = ("11321", "12100", "12200", "13214", "14110")


def _raw_events(spark, folder):
    """Orders as event rows in the full text contract of the event source."""
    key = F.col("o_orderkey").cast("long")
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (key % 5 + 1).cast("int"))
    unit = F.lpad(F.col("o_custkey").cast("string"), 7, "0")
    stamp = F.date_format("o_orderdate", "yyyyMMdd")
    special = {
        "Protocolo_S2iD": F.when(key % 11 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(
            F.concat(F.lit("BR-F-"), F.when(key % 7 == 0, F.lit("0000000")).otherwise(unit), F.lit("-"), code, F.lit("-"), stamp)),
        "Cod_IBGE_Mun": unit, "Cod_Cobrade": code, "tipologia": F.concat((key % 5 + 1).cast("string"), F.lit(".0")),
        "Status": F.when(F.col("o_orderstatus") == "F", ev.RECOGNIZED_STATUS).otherwise("Registro"),
        "Data_Evento": F.date_format("o_orderdate", "d/M/yyyy"),
        "Data_Registro": F.date_format(F.date_add("o_orderdate", F.when(key % 13 == 0, -3).otherwise(2)), "dd/MM/yyyy"),
        "DH_Descricao": F.when(key % 3 == 0, F.lit("  ")).otherwise("texto; com \"aspas\""),
        "DH_total_danos_humanos_diretos": (key % 17).cast("string"), "DH_OUTROS AFETADOS": F.concat(F.lit(" "), (key % 4).cast("string")),
        "DM_total_danos_materiais": F.col("o_totalprice").cast("decimal(18,2)").cast("string")}
    plain = {"text": F.lit("a"), "blank": F.lit(""), "count": F.lit("0"), "money": F.lit("0.00"), "date": stamp, "typology": F.lit("1.0")}
    rows = table(spark, folder, "orders")
    return rows.select(*[special.get(source, plain[kind]).alias(source) for source, _, kind in ev.FIELDS], F.col("o_orderkey").alias("order"))


@query("event_ingest", f"""WITH r AS (SELECT *, o_orderkey AS k, ['{"','".join(_CODES)}'][o_orderkey % 5 + 1] AS code, lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS unit,
    CAST(o_orderdate AS DATE) AS day FROM orders),
  p AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'x' || k ELSE 'BR-F-' || CASE WHEN k % 7 = 0 THEN '0000000' ELSE unit END || '-' || code || '-' || strftime(day, '%Y%m%d') END AS protocol FROM r)
  SELECT protocol AS source_event_id, unit AS codigo_ibge, day AS event_date, CAST(year(day) AS SMALLINT) AS event_year, CAST(month(day) AS TINYINT) AS event_month,
    CAST(k % 5 + 1 AS SMALLINT) AS atlas_type_id, o_orderstatus = 'F' AS is_federally_recognized, CAST(k % 17 + k % 4 AS BIGINT) AS reported_affected_total,
    CASE WHEN k % 3 <> 0 THEN 'texto; com "aspas"' END AS human_damage_description, code IN ({", ".join(repr(c) for c in ev.RAIN_CODES)}) AS is_rain_related,
    code LIKE '12%' AS is_hydrological, code LIKE '11%' AS is_geological, k % 11 <> 0 AS is_protocol_format_valid,
    k % 11 <> 0 AND (k % 7 <> 0 OR unit = '0000000') AS is_protocol_ibge_consistent, k % 11 <> 0 AS is_protocol_cobrade_consistent,
    k % 13 = 0 AS is_event_after_registration, CAST(o_totalprice AS DECIMAL(18,2)) AS material_damage_total_brl,
    o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') AS is_dim_municipality_match FROM p""")
def event_ingest(spark, folder):
    """The whole ingest of the event source: contract file, strict casts, every flag, the match flag."""
    path = scratch_path(spark, "events")
    write_csv(_raw_events(spark, folder).drop("order"), path, sep=";")
    raw = read_contract_csv(spark, path, ev.EVENT_CONTRACT, multi_line=False).withColumn("source_row_number", F.lit(1))
    dim = (table(spark, folder, "customer").filter("c_mktsegment <> 'BUILDING'")
           .select(F.lpad(F.col("c_custkey").cast("string"), 7, "0").alias("codigo_ibge")))
    return conform.ingest_events(raw, dim, 2024).select(
        "source_event_id", "codigo_ibge", "event_date", "event_year", "event_month", "atlas_type_id", "is_federally_recognized",
        "reported_affected_total", "human_damage_description", "is_rain_related", "is_hydrological", "is_geological",
        "is_protocol_format_valid",
        F.coalesce("is_protocol_ibge_consistent", F.lit(False)).alias("is_protocol_ibge_consistent"),
        F.coalesce("is_protocol_cobrade_consistent", F.lit(False)).alias("is_protocol_cobrade_consistent"),
        "is_event_after_registration", "material_damage_total_brl", "is_dim_municipality_match")


@query("slice_export", """SELECT c_name AS name, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(amount AS VARCHAR) AS amount
  FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders) JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'""")
def slice_export(spark, folder):
    """A filtered slice with names instead of keys, through the CSV sink."""
    path = scratch_path(spark, "slice")
    rows = _orders(spark, folder).select(F.col("o_custkey").alias("unit"), "o_orderkey", "amount", "o_orderstatus")
    dim = table(spark, folder, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_name").alias("name"))
    write_slice(rows.withColumnRenamed("o_orderstatus", "status"), dim, "unit", ["name"], F.col("status") == "P", path)
    return spark.read.option("header", True).csv(path).select("name", "o_orderkey", "amount")


@query("csv_with_json", f"""WITH {U}, {E} SELECT unit, '[' || string_agg('{{"year":' || year || ',"n":' || n || '}}', ',' ORDER BY year) || ']' AS years
  FROM (SELECT unit, year, count(*) AS n FROM ev GROUP BY ALL) GROUP BY unit""")
def csv_with_json(spark, folder):
    """Array columns as compact JSON text in a CSV file."""
    path = scratch_path(spark, "csv-json")
    counts = events(spark, folder).groupBy("unit", "year").agg(F.count("*").alias("n"))
    rows = counts.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("year", "n"))).alias("years"))
    write_csv(rows, path, json_columns=["years"])
    return spark.read.schema("unit bigint, years string").option("header", True).option("escape", '"').csv(path)


@query("parquet_sink", "SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, 'v2' AS version FROM orders GROUP BY o_orderstatus")
def parquet_sink(spark, folder):
    """Replacing a published table keeps only the new rows."""
    path = scratch_path(spark, "table")
    rows = _orders(spark, folder)
    write_parquet(rows.limit(5).withColumn("version", F.lit("v1")), path)
    write_parquet(rows.withColumn("version", F.lit("v2")), path, sort_by=["o_orderkey"])
    return spark.read.parquet(path).groupBy("o_orderstatus", "version").agg(
        F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))


@query("ordered_sink", """SELECT row_number() OVER (ORDER BY day, o_orderkey) AS source_row_number, o_orderkey, day
  FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)""")
def ordered_sink(spark, folder):
    """All orders by day and key: their physical place in the written files is their place in the order."""
    path = scratch_path(spark, "ordered")
    write_ordered_parquet(_orders(spark, folder).select("o_orderkey", "day"), path, ["day", "o_orderkey"])
    return with_source_row_number(spark.read.parquet(path)).select("source_row_number", "o_orderkey", "day")


def _zipped_customers(key, frame):
    """One archive of up to a thousand customers: a note and a CSV with a byte order mark."""
    import csv
    import io
    import zipfile

    import pandas as pd

    text, packed = io.StringIO(newline=""), io.BytesIO()
    writer = csv.writer(text, delimiter=";")
    writer.writerow(["segment", "name", "unit"])
    rows = frame.sort_values("c_custkey")
    writer.writerows(zip(rows["c_mktsegment"], rows["c_name"], rows["c_custkey"]))
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("readme.txt", "customers")
        archive.writestr("data/CUSTOMERS.CSV", text.getvalue().encode("utf-8-sig"))
    return pd.DataFrame({"archive": [f"customers-{key[0]}.zip"], "content": [packed.getvalue()]})


@query("zipped_csv", """SELECT 'customers-' || CAST(c_custkey // 1000 AS VARCHAR) || '.zip' AS archive,
  row_number() OVER (PARTITION BY c_custkey // 1000 ORDER BY c_custkey) - 1 AS row_idx,
  CAST(c_custkey AS VARCHAR) AS unit, c_name AS name, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS phone FROM customer""")
def zipped_csv(spark, folder):
    """All customers from zipped CSV members by header name; the header lacks one of the columns."""
    archives = (table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
                .groupBy(F.expr("c_custkey div 1000").alias("block"))
                .applyInPandas(_zipped_customers, "archive string, content binary"))
    return unzip_csv(archives, ["unit", "name", "segment", "phone"])


@query("archived_release", "SELECT 'r1' AS source_release, o_orderstatus, count(*) AS rows, min(o_orderkey) AS first_key FROM orders GROUP BY o_orderstatus")
def archived_release(spark, folder):
    """A release of all orders is archived once; a second attempt with other values leaves it as it was."""
    path = scratch_path(spark, "archive")
    rows = _orders(spark, folder)
    archive_release(rows, path, "r1")
    archive_release(rows.withColumn("o_orderstatus", F.lit("X")), path, "r1")
    return spark.read.parquet(path).groupBy("source_release", "o_orderstatus").agg(
        F.count("*").alias("rows"), F.min("o_orderkey").alias("first_key"))


@query("run_record", """SELECT 'orders' AS source, 'r2' AS release, count(*) AS rows, TRUE AS unchanged, FALSE AS unchanged_with_other_input,
  FALSE AS unchanged_with_other_dimension FROM orders""")
def run_record(spark, folder):
    """Run records are appended; the newest successful one decides whether a run may be skipped."""
    path = scratch_path(spark, "runs")
    rows = _orders(spark, folder)
    prints = output_fingerprints({"orders": rows})
    dimension = lambda df: output_fingerprints({"dimension": df})
    dim = table(spark, folder, "customer").select("c_custkey")
    signature = input_signature("r2", {"csv": "h2"}, **dimension(dim))
    n = rows.count()
    for day, (release, status, sign) in enumerate((("r1", "SUCCESS", "s1"), ("r2", "SUCCESS", signature), ("r3", "FAILED", "s3")), 1):
        append_run(spark, path, {"run_id": release, "source": "orders", "status": status, "release": release,
                                 "finished_at": dt.datetime(2026, 9, day), "input_signature": sign,
                                 "pipeline_fingerprint": "p", "output_fingerprints": prints, "row_counts": {"orders": n}})
    last = latest_successful_run(read_runs(spark, path), "orders")
    other = input_signature("r2", {"csv": "h3"}, **dimension(dim))
    moved = input_signature("r2", {"csv": "h2"}, **dimension(dim.filter("c_custkey > 1")))
    return rows.agg(F.count("*").alias("rows")).select(
        F.lit(last["source"]).alias("source"), F.lit(last["release"]).alias("release"), "rows",
        F.lit(is_unchanged(last, signature, "p", prints)).alias("unchanged"),
        F.lit(is_unchanged(last, other, "p", prints)).alias("unchanged_with_other_input"),
        F.lit(is_unchanged(last, moved, "p", prints)).alias("unchanged_with_other_dimension"))


@query("schema_diff", """SELECT * FROM (VALUES ('added', 'year', NULL, NULL), ('removed', 'o_orderpriority', NULL, NULL),
  ('type_changed', 'o_custkey', 'bigint', 'string')) AS t(change, column_name, previous_type, current_type)""")
def schema_diff(spark, folder):
    """Columns added, removed and changed between two releases of a table."""
    old = _orders(spark, folder)
    new = old.withColumns({"o_custkey": F.col("o_custkey").cast("string"), "year": F.year("day")}).drop("o_orderpriority")
    return schema_change_rows(old, new)


_SITE_BYTES = 2_000


def _site(spark, folder):
    """Units as small documents in files of bounded size, as the site publishes them."""
    docs = units(spark, folder).select(
        F.upper(F.substring("state", 1, 2)).alias("uf"), F.lpad(F.col("unit").cast("string"), 7, "0").alias("codigo_ibge"),
        F.struct(F.lpad(F.col("unit").cast("string"), 7, "0").alias("codigo_ibge"), F.col("name").alias("municipio"),
                 F.lower("name").alias("municipio_normalized"), F.upper(F.substring("state", 1, 2)).alias("uf"),
                 F.col("region").cast("string").alias("regiao")).alias("municipality"))
    docs = docs.withColumn("document", F.to_json(F.struct("municipality")))
    sized = docs.select("uf", "codigo_ibge", entry_bytes(F.col("codigo_ibge"), F.col("document")).alias("bytes"))
    packed = pack_shards(sized, "uf", "codigo_ibge", "bytes", _SITE_BYTES, document_overhead(F.col("uf"), "v1"))
    packed = packed.withColumn("file", shard_name(F.col("uf"), F.col("part"), F.col("parts")))
    path = scratch_path(spark, "site")
    placed = docs.join(packed.select("codigo_ibge", "file"), "codigo_ibge")
    write_named_texts(shard_documents(placed, "uf", "codigo_ibge", "document", "file", "v1"), path, "file", "body")
    return docs, read_shard_documents(spark, path, docs.schema["municipality"].dataType)


@query("shard_documents", f"""WITH {U} SELECT upper(substr(state, 1, 2)) AS uf, lpad(CAST(unit AS VARCHAR), 7, '0') AS codigo_ibge, name AS municipio,
  TRUE AS fits, 'v1' AS schema_version FROM units""")
def shard_documents_query(spark, folder):
    """What the written shard files hold: every unit once, in a file of its state within its size."""
    _, held = _site(spark, folder)
    return held.select("uf", "codigo_ibge", F.col("municipality.municipio").alias("municipio"),
                       ((F.col("bytes") <= _SITE_BYTES) & F.col("file").startswith(F.col("uf"))).alias("fits"), "schema_version")


@query("unit_sample", """SELECT c_custkey AS unit, c_nationkey AS region, c_name AS name FROM customer WHERE c_custkey IN (1, 2, 3, 5, 8)""")
def unit_sample(spark, folder):
    """A fixed list of units: all found, none twice, every group covered."""
    rows = units(spark, folder).select("unit", "region", "name")
    wanted = [1, 2, 3, 5, 8]
    groups = rows.filter(F.col("unit").isin(wanted)).select("region").distinct().count()
    return representative_sample(rows, "unit", wanted, "region", groups, ["unit"])


@query("table_checks", """SELECT 'orders' AS "table", name, status FROM (VALUES ('row_count', 'PASS'), ('files_are_not_empty', 'PASS')) AS t(name, status)""")
def table_checks(spark, folder):
    """Row count against a recorded number and non-empty files, as check rows."""
    path = scratch_path(spark, "checked")
    rows = _orders(spark, folder)
    write_parquet(rows, path)
    files = file_inventory(spark, path, digests=False).filter(F.col("path").contains("part-"))
    return q.union_checks([q.aggregate_checks(rows, "orders", [q.row_count(rows.count())]),
                           q.non_empty(files, "orders")]).select("table", "name", "status")


@query("lineage_stamps", "SELECT o_orderkey, 'r1' AS release, 'orders.csv' AS source_file FROM orders")
def lineage_stamps(spark, folder):
    return with_lineage(table(spark, folder, "orders").select("o_orderkey"), release="r1", source_file="orders.csv")


@query("index_matches_files", """SELECT 0 AS repeated_in_index, 0 AS repeated_in_shards, 0 AS missing_documents, (SELECT count(*) FROM customer WHERE c_custkey % 10 = 0) AS orphan_documents,
  0 AS identity_differs FROM (SELECT 1)""")
def index_matches_files(spark, folder):
    """The index against the written files: units left out of the index are orphans."""
    docs, held = _site(spark, folder)
    # The files are read once for both sides.
    placed = cut_lineage(held.select("codigo_ibge", "municipality", F.concat(F.lit("/"), F.col("file")).alias("shard")))
    identity = [c for c in un.IDENTITY]
    fill = lambda row: F.struct(*[(F.col(f"municipality.{c}") if c in ("codigo_ibge", "municipio", "municipio_normalized", "uf", "regiao")
                                   else F.lit(None).cast("string")).alias(c) for c in identity]).alias(row)
    full = placed.select("codigo_ibge", "shard", fill("municipality"))
    index = full.filter(F.col("codigo_ibge").cast("long") % 10 != 0).select("municipality.*", "shard")
    counts = profiles.index_problems(index, full)
    return counts.select(*[F.col(c).cast("long").alias(c) for c in (
        "repeated_in_index", "repeated_in_shards", "missing_documents", "orphan_documents", "identity_differs")])
