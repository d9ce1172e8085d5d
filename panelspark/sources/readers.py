"""File sources.  Every reader has an explicit schema; codes stay text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from panelspark.sources.contracts import Contract, ContractError, check_prefix_and_years

# Bytes 0x80-0x9F read as Latin-1 and what they stand for in code page 1252.
_C1_BYTES = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_LATIN1_CONTROLS = "".join(chr(b) for b in _C1_BYTES)
_CP1252_CHARS = bytes(_C1_BYTES).decode("cp1252")
_NEVER_NULL = "__VALUE_THAT_IS_NEVER_NULL__"
#: Bytes of a file on a remote file system that a task holds whole to hash it.
HELD = 1 << 27


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def csv_header(spark: SparkSession, path: str, sep: str = ";", encoding: str = "UTF-8",
               quote: str = '"') -> list[str]:
    """Column names of the file in their physical order; reads the first row only."""
    return (spark.read.option("header", True).option("sep", sep).option("quote", quote)
            .option("encoding", encoding).option("inferSchema", False).csv(path).columns)


def read_contract_csv(spark: SparkSession, path: str, contract: Contract, sep: str = ";",
                      cp1252: bool = False, multi_line: bool = True) -> DataFrame:
    """All-text delimited scan under an exact column contract.

    Empty fields stay ``''`` (there is no null token), malformed rows stop the job, and every
    file's own header must equal the contract.  ``multi_line`` lets quoted fields hold line
    breaks, at the price of one task per file; land big sources as many files.
    """
    encoding = "ISO-8859-1" if cp1252 else "UTF-8"
    contract.check(csv_header(spark, path, sep, encoding))
    df = (spark.read.schema(contract.landing_schema())
          .option("header", True).option("enforceSchema", False)
          .option("sep", sep).option("quote", '"').option("escape", '"')
          .option("encoding", encoding).option("multiLine", multi_line)
          .option("nullValue", _NEVER_NULL).option("emptyValue", "")
          .option("mode", "FAILFAST").option("columnPruning", False).csv(path))

    def cell(name):
        text = F.coalesce(F.col(f"`{name}`"), F.lit(""))
        if cp1252:
            text = F.translate(text, _LATIN1_CONTROLS, _CP1252_CHARS)
        return text.alias(name)

    return df.select(*[cell(name) for name in contract.fields])


def read_typed_csv(spark: SparkSession, path: str, contract: Contract, sep: str = ",") -> DataFrame:
    """Delimited scan with declared column types."""
    contract.check([c.lstrip("﻿") for c in csv_header(spark, path, sep)])
    return (spark.read.schema(contract.typed_schema()).option("header", True).option("sep", sep)
            .option("mode", "FAILFAST").option("quote", '"').option("escape", '"').csv(path))


def read_nested_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects under an explicit nested schema; an empty list is an error."""
    df = (spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path))
    if df.isEmpty():
        raise ContractError(f"non-empty list expected in {path}")
    return df


def landed_sheets(spark: SparkSession, folder: str, required: Sequence[str]) -> None:
    """Check that every required sheet has been landed as ``folder/<sheet>``."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    root = hadoop.Path(folder)
    found = {status.getPath().getName() for status in root.getFileSystem(conf).listStatus(root)}
    names = found | {name.rsplit(".", 1)[0] for name in found}
    if missing := sorted(set(required) - names):
        raise ContractError(f"required sheets are missing in {folder}: {missing}")


def read_landed_sheet(spark: SparkSession, path: str, as_text: bool = True) -> DataFrame:
    """A workbook sheet exported to Parquet; all columns as text unless told otherwise."""
    df = spark.read.parquet(path)
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]) if as_text else df


def read_range(df: DataFrame, first_row: int, last_row: int, columns: Sequence[str],
               row_column: str = "row_idx") -> DataFrame:
    """A bounded box of a landed sheet: rows by position, columns by name."""
    return df.filter(F.col(row_column).between(first_row, last_row)).select(*columns)


def read_wide_panel(df: DataFrame, prefix: Sequence[str], first_year: int, last_year: int) -> list[str]:
    """Year columns of a wide panel after its contract check."""
    return check_prefix_and_years(df.columns, prefix, range(first_year, last_year + 1))


def from_rows(spark: SparkSession, rows: Sequence, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def series(spark: SparkSession, first: int, last: int, name: str = "n") -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias(name))


def filter_keys(df: DataFrame, key: str, wanted: Sequence, all_found: bool = True) -> DataFrame:
    """Rows of the listed keys; by default every listed key must exist."""
    rows = df.filter(F.col(key).isin(list(wanted)))
    if all_found:
        found = {r[0] for r in rows.select(key).distinct().collect()}  # at most len(wanted)
        if missing := sorted(set(wanted) - found):
            raise ContractError(f"keys not found: {missing}")
    return rows


def representative_sample(df: DataFrame, key: str, wanted: Sequence, group: str,
                          groups: int, order: Sequence[str]) -> DataFrame:
    """A fixed key list: all found, none twice, every group covered, in a stable order."""
    if len(set(wanted)) != len(wanted):
        raise ContractError("the key list has duplicates")
    rows = filter_keys(df, key, wanted)
    stats = rows.agg(F.count("*").alias("n"), F.countDistinct(group).alias("groups")).first()
    if stats.n != len(wanted):
        raise ContractError(f"expected {len(wanted)} rows, found {stats.n}")
    if stats.groups != groups:
        raise ContractError(f"expected {groups} groups, found {stats.groups}")
    return rows.orderBy(*order)


def file_inventory(spark: SparkSession, path: str, with_content: bool = False, digests: bool = True) -> DataFrame:
    """Path, size, modification time, SHA-256 and 12-character content key of each file.

    Without ``digests`` the last two are left out and no file is read.  A file is read by one task (SHA-256 is a chain), piece
    by piece where the folder is on a shared disk (``file:``).  On other file systems a task holds files of up to ``HELD`` bytes
    whole, and the driver reads larger ones as streams, one after the other.  ``with_content`` holds every file whole.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    columns = [F.col("path"), F.col("length").alias("content_length"), F.col("modificationTime").alias("modified_at")]
    if not digests:
        return df.select(*columns)
    if with_content:
        df = df.withColumn("sha256", F.sha2("content", 256))
    elif _file_system(spark, path).getUri().getScheme() == "file":
        df = df.withColumn("sha256", _streamed_sha256()("path"))
    else:
        df = _held_or_streamed(spark, df)
    return df.select(*columns, "sha256", F.substring("sha256", 1, 12).alias("content_key"),
                     *([F.col("content")] if with_content else []))


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _streamed_sha256():
    """A function of a path on a shared disk."""
    @F.udf("string")
    def digest(path):
        import hashlib

        with open(path.removeprefix("file:"), "rb") as stream:
            return hashlib.file_digest(stream, "sha256").hexdigest()

    return digest


def _held_or_streamed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """(path, length, modificationTime, sha256) of files on any file system."""
    columns = ["path", "length", "modificationTime"]
    held = df.filter(F.col("length") <= HELD).select(*columns, F.sha2("content", 256).alias("sha256"))
    large = df.filter(F.col("length") > HELD).select(*columns)
    found = []
    for row in large.select("path").distinct().collect():  # few: each has more than HELD bytes
        stream = _file_system(spark, row.path).open(spark._jvm.org.apache.hadoop.fs.Path(row.path))
        try:
            found.append((row.path, spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(
                spark._jvm.java.io.BufferedInputStream(stream, 1 << 20))))
        finally:
            stream.close()
    if not found:
        return held
    return held.unionByName(large.join(spark.createDataFrame(found, "path string, sha256 string"), "path"))


def with_source_row_number(df: DataFrame, name: str = "source_row_number") -> DataFrame:
    """Physical row number (1-based) over the files of ``df``, without a global window.

    ``df`` must be a plain file scan.  Rows are numbered inside each file split by the task
    that reads it; the split sizes (one row per split) give each split its offset.
    """
    marked = df.select("*", F.col("_metadata.file_path").alias("__file"),
                       F.col("_metadata.file_block_start").alias("__start"),
                       F.monotonically_increasing_id().alias("__id"))
    splits = marked.groupBy("__file", "__start").agg(
        F.min("__id").alias("__first"), F.count("*").alias("__rows"))
    in_order = Window.partitionBy(F.lit(1)).orderBy("__file", "__start").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = splits.select("__file", "__start", "__first",
                            F.coalesce(F.sum("__rows").over(in_order), F.lit(0)).alias("__offset"))
    numbered = marked.join(offsets, ["__file", "__start"])
    return numbered.withColumn(
        name, F.col("__id") - F.col("__first") + F.col("__offset") + 1
    ).drop("__file", "__start", "__first", "__offset", "__id")


def read_zipped_csv(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ";") -> DataFrame:
    """Rows of the first CSV member of each zip file of a folder, see ``unzip_csv``."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
             .select(F.col("path").alias("archive"), "content"))
    return unzip_csv(files, columns, sep)


def unzip_csv(archives: DataFrame, columns: Sequence[str], sep: str = ";") -> DataFrame:
    """Rows of the first CSV member of each archive (``archive``, ``content``), by header name; one task per archive.

    A column that the header lacks is null, as are those a short line lacks; an archive without a
    CSV member stops the run.  ``row_idx`` is the row's position in its member, ``archive`` its path, so that arrival
    order stays available.  Rows stream out in small batches: an archive is never whole in
    memory as rows.
    """
    schema = T.StructType([T.StructField("archive", T.StringType()),
                           T.StructField("row_idx", T.LongType())]
                          + [T.StructField(c, T.StringType()) for c in columns])
    wanted = list(columns)

    def unpack(batches):
        import csv
        import io
        import zipfile

        import pandas as pd

        names = ["archive", "row_idx", *wanted]
        for batch in batches:
            for archive, content in zip(batch["archive"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as zipped:
                    member = next(n for n in zipped.namelist() if n.lower().endswith(".csv"))
                    with zipped.open(member) as raw:
                        text = io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace",
                                                newline="")
                        rows = []
                        for position, row in enumerate(csv.DictReader(text, delimiter=sep)):
                            rows.append([archive, position, *[row.get(c) for c in wanted]])
                            if len(rows) == 10_000:
                                yield pd.DataFrame(rows, columns=names)
                                rows = []
                        if rows:
                            yield pd.DataFrame(rows, columns=names)

    return archives.select("archive", "content").mapInPandas(unpack, schema)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_successful_run(runs: DataFrame, source: str) -> dict | None:
    """The newest run of a source that succeeded or found nothing new to do."""
    row = (runs.filter((F.col("source") == source) & (F.col("status") == "SUCCESS"))
           .agg(F.max_by(F.struct(*runs.columns), F.col("finished_at")).alias("run")).first())
    return row.run.asDict(recursive=True) if row and row.run is not None else None
