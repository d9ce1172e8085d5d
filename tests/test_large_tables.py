"""Queries against their SQL on tables that are odd in size, not in content."""

import duckdb
import pytest
from oracle import compare

from panelspark.queries import ORACLES, QUERIES


@pytest.mark.parametrize("texts", [
    "SELECT i AS doc_id, repeat('x', 150000) AS text, 'en' AS lang FROM range(1012) t(i)",
    # Two documents that fill a shard to its last byte but one.
    "SELECT i AS doc_id, repeat('x', 100000 - 85 * i) AS text, 'en' AS lang FROM range(2) t(i)"])
def test_packing_follows_its_sql(spark, tmp_path, texts):
    folder = tmp_path / "t"
    folder.mkdir()
    duckdb.sql(texts).write_parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert compare(spark, con, str(folder), QUERIES["pack_shards"], ORACLES["pack_shards"]) is None
