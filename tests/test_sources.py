import io
import zipfile

import pytest
from pyspark.sql import functions as F

from panelspark.operators import conform, search
from panelspark.presets import units as un
from panelspark.sinks import writers
from panelspark.sources import contracts, pages, readers
from panelspark.sources.contracts import Contract, ContractError

SMALL = Contract("small", ("id", "name", "note"))


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_contract_checks_names_and_order():
    SMALL.check(("id", "name", "note"))
    with pytest.raises(ContractError, match="only_order_differs=True"):
        SMALL.check(("name", "id", "note"))
    with pytest.raises(ContractError, match="missing=\\['note'\\], unexpected=\\['other'\\]"):
        SMALL.check(("id", "name", "other"))
    assert SMALL.fingerprint() != Contract("small", ("name", "id", "note")).fingerprint()


def test_strict_csv_keeps_text_blanks_and_cp1252(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id;name;note\n007;São;"a ""b""; c"\n008;€ – “x”;\n009;"dois\nlinhas";""\n', "cp1252")
    rows = readers.read_contract_csv(spark, path, SMALL, cp1252=True).collect()
    assert [tuple(r) for r in rows] == [("007", "São", 'a "b"; c'), ("008", "€ – “x”", ""), ("009", "dois\nlinhas", "")]


def test_strict_csv_refuses_other_headers_and_short_rows(spark, tmp_path):
    with pytest.raises(ContractError):
        readers.read_contract_csv(spark, write(tmp_path / "b.csv", "name;id;note\n1;2;3\n"), SMALL)
    bad = readers.read_contract_csv(spark, write(tmp_path / "c.csv", "id;name;note\n1;2\n"), SMALL)
    with pytest.raises(Exception):
        bad.select("id").collect()


def test_every_file_must_have_the_header(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    write(folder / "1.csv", "id;name;note\n1;a;b\n")
    write(folder / "2.csv", "id;note;name\n2;b;a\n")
    with pytest.raises(Exception):
        readers.read_contract_csv(spark, str(folder), SMALL).collect()


def test_row_numbers_follow_the_files(spark, tmp_path):
    folder = tmp_path / "rows"
    folder.mkdir()
    for f in range(3):
        write(folder / f"{f}.csv", "id;name;note\n" + "".join(f"{f * 10 + i};x;y\n" for i in range(f + 2)))
    df = readers.with_source_row_number(readers.read_contract_csv(spark, str(folder), SMALL))
    got = [(r.source_row_number, int(r.id)) for r in df.orderBy("source_row_number").collect()]
    assert got == list(enumerate([0, 1, 10, 11, 12, 20, 21, 22, 23], start=1))


def test_typed_csv(spark, tmp_path):
    contract = Contract("legend", ("class_id", "label"), {"class_id": "int"})
    path = write(tmp_path / "l.csv", 'class_id,label\n3,"Rio, Lago e Oceano"\n')
    assert [tuple(r) for r in readers.read_typed_csv(spark, path, contract).collect()] == [(3, "Rio, Lago e Oceano")]


def test_wide_panel_contract():
    good = ["ID", "country", "y2000", "y2001"]
    assert contracts.check_prefix_and_years(good, ["ID", "country"], range(2000, 2002)) == ["y2000", "y2001"]
    for columns in (["country", "ID", "y2000", "y2001"], ["ID", "country", "y2000"], [*good, "extra"],
                    ["ID", "country", "y2001", "y2000"]):
        with pytest.raises(ContractError):
            contracts.check_prefix_and_years(columns, ["ID", "country"], range(2000, 2002))


def test_zipped_csv(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("DATA.CSV", "﻿A;B;C\n1;dois;3\n4;;6\n")
        z.writestr("second.csv", "A;B\n9;9\n")
    (tmp_path / "x.zip").write_bytes(buffer.getvalue())
    rows = readers.read_zipped_csv(spark, str(tmp_path), ["A", "B", "Z"]).orderBy("row_idx").collect()
    assert [(r.row_idx, r.A, r.B, r.Z) for r in rows] == [(0, "1", "dois", None), (1, "4", "", None)]


def test_nested_json_needs_rows(spark, tmp_path):
    with pytest.raises(ContractError, match="non-empty"):
        readers.read_nested_json(spark, write(tmp_path / "e.json", "[]"), "id long")


def test_landed_sheets_ranges_and_key_lists(spark, tmp_path):
    sheet = spark.createDataFrame([(i, f"v{i}", i * 2) for i in range(1, 6)], "row_idx int, a string, b int")
    sheet.write.parquet(str(tmp_path / "Folha 1"))
    readers.landed_sheets(spark, str(tmp_path), ["Folha 1"])
    with pytest.raises(ContractError, match="Folha 2"):
        readers.landed_sheets(spark, str(tmp_path), ["Folha 1", "Folha 2"])
    landed = readers.read_landed_sheet(spark, str(tmp_path / "Folha 1"))
    assert dict(landed.dtypes) == {"row_idx": "string", "a": "string", "b": "string"}
    box = readers.read_range(sheet, 2, 3, ["a"])
    assert [r.a for r in box.orderBy("a").collect()] == ["v2", "v3"]
    assert readers.filter_keys(sheet, "a", ["v1", "v2"]).count() == 2
    with pytest.raises(ContractError, match="v9"):
        readers.filter_keys(sheet, "a", ["v1", "v9"])
    assert [r.n for r in readers.series(spark, 1, 12).collect()] == list(range(1, 13))
    sample = readers.representative_sample(sheet, "a", ["v2", "v1"], "b", 2, ["a"])
    assert [r.a for r in sample.collect()] == ["v1", "v2"]
    for args in ((["v1", "v1"], 1), (["v1", "v2"], 3)):
        with pytest.raises(ContractError):
            readers.representative_sample(sheet, "a", args[0], "b", args[1], ["a"])


def test_file_inventory(spark, tmp_path):
    import hashlib

    write(tmp_path / "a.txt", "hello")
    row = readers.file_inventory(spark, str(tmp_path)).first()
    digest = hashlib.sha256(b"hello").hexdigest()
    assert (row.content_length, row.sha256, row.content_key) == (5, digest, digest[:12])


@pytest.mark.parametrize("remote", [False, True])
def test_inventory_of_files_too_large_to_hold(spark, tmp_path, monkeypatch, remote):
    import hashlib

    texts = {"a b%20.txt": "hello" * 1000, "c.txt": "x"}
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        write(tmp_path / "in" / name, text)
    path = str(tmp_path / "in")
    if remote:
        spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.kept.link./in", f"file://{path}")
        path = "viewfs://kept/in"
    monkeypatch.setattr(readers, "HELD", 100)
    # As 2 GiB are for files of any session.
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")
    try:
        rows = readers.file_inventory(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    digests = {name: hashlib.sha256(text.encode()).hexdigest() for name, text in texts.items()}
    assert {r.path.rsplit("/", 1)[1]: (r.content_length, r.sha256, r.content_key) for r in rows} == {
        name: (len(texts[name]), d, d[:12]) for name, d in digests.items()}
    assert readers.file_inventory(spark, path, digests=False).columns == ["path", "content_length", "modified_at"]


def test_inventory_hashes_a_file_once(spark, tmp_path):
    write(tmp_path / "a.txt", "hello")
    plan = readers.file_inventory(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("digest(") == 1 and "content:binary" not in plan


LINKS = """<html><a href="/files/base.CSV?x=1">Base <b>completa</b></a><a href="b.xlsx">Base completa</a>
<a href="https://o.example/m.pdf">Manual</a><a href="c.xlsx">Log de alterações</a><a>none</a></html>"""


def test_links_are_resolved_and_must_be_single(spark):
    page = lambda html: spark.createDataFrame([(1, "https://site.example/p/index.html", html)],
                                              "page_id long, url string, html string")
    links = pages.harvest_links(page(LINKS))
    assert [(r.url, r.anchor) for r in links.orderBy("link_idx").collect()] == [
        ("https://site.example/files/base.CSV?x=1", "Base completa"), ("https://site.example/p/b.xlsx", "Base completa"),
        ("https://o.example/m.pdf", "Manual"), ("https://site.example/p/c.xlsx", "Log de alterações")]
    kinds = pages.single_resource(pages.classify_resources(links), ["csv", "xlsx", "manual", "log"])
    assert {r.kind: r.url.rsplit("/", 1)[1] for r in kinds.collect()} == {
        "csv": "base.CSV?x=1", "xlsx": "b.xlsx", "manual": "m.pdf", "log": "c.xlsx"}
    two = pages.classify_resources(pages.harvest_links(page(LINKS + '<a href="d.csv">x</a>')))
    with pytest.raises(Exception, match="expected one csv, found 2"):
        pages.single_resource(two, ["csv"]).collect()
    with pytest.raises(Exception, match="expected one zip, found 0"):
        pages.single_resource(two, ["zip"]).collect()


def test_table_rows_and_their_links(spark):
    html = """<table><tr data-colecao="Coleção 11"><td>Biomas,  Estados e Municípios</td>
      <td><a title="Baixar" href="/f.zip">Abrir</a><a title="Ver" href="/v">v</a></td></tr>
      <tr data-colecao="Coleção 10"><td>x</td></tr></table>"""
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = pages.harvest_table_rows(df)
    hit = pages.match_rows(rows, {"data-colecao": "Coleção 11"}, ["biomas, estados e municipios"])
    assert hit.count() == 1 and hit.first().cells == ["Biomas, Estados e Municípios", "Abrirv"]
    assert [r.url for r in pages.row_links(hit, "Baixar").collect()] == ["/f.zip"]


UNIT = ('{"id": 3550308, "nome": "  São   Paulo  ", %s "regiao-imediata": {"id": 350001, "nome": "São Paulo", '
        '"regiao-intermediaria": {"id": 3501, "nome": "São Paulo", "UF": {"id": 35, "sigla": "SP", "nome": "São Paulo", '
        '"regiao": {"id": 3, "sigla": "SE", "nome": "Sudeste"}}}}}')
MICRO = ('"microrregiao": {"id": 35061, "nome": "São Paulo", "mesorregiao": {"id": 3515, "nome": "Metropolitana"}},')


def test_units_are_flattened_with_optional_and_required_levels(spark, tmp_path):
    path = write(tmp_path / "u.json", "[" + UNIT % MICRO + "," + (UNIT % '"microrregiao": null,').replace("3550308", "5300108") + "]")
    rows = {r.codigo_ibge: r for r in conform.conform_units(
        readers.read_nested_json(spark, path, un.UNIT_SCHEMA), source="s").collect()}
    unit = rows["3550308"]
    assert (unit.municipio, unit.municipio_normalized, unit.sigla_uf) == ("  São   Paulo  ", "sao paulo", "SP")
    assert (unit.codigo_regiao_imediata, unit.codigo_mesorregiao, unit.tipo_unidade_territorial, unit.source) == (
        "350001", "3515", "municipio", "s")
    assert rows["5300108"].microrregiao is None and rows["5300108"].tipo_unidade_territorial == "distrito_federal"
    assert "mesorregiao" not in conform.unit_dimension(spark.createDataFrame([unit])).columns
    broken = write(tmp_path / "b.json", '[{"id": 1, "nome": "x", "regiao-imediata": null}]')
    with pytest.raises(Exception, match="required value missing"):
        conform.conform_units(readers.read_nested_json(spark, broken, un.UNIT_SCHEMA)).collect()


def test_search_and_resolution(spark):
    index = spark.createDataFrame(
        [(0, "São José", "SC", "4216602"), (1, "São José", "SP", "3549904"), (2, "Scania", "RS", "4300001"),
         (3, "Escada", "PE", "2605202")], "pos int, municipio string, uf string, codigo_ibge string")
    found = lambda q: [r.codigo_ibge for r in search.search_units(index, q, position="pos").collect()]
    assert found("sao jose") == ["4216602", "3549904"] and found("SÃO JOSÉ,  sc") == ["4216602"]
    assert found("sc") == ["4216602"] and found("ca") == ["4300001", "2605202"] and found("s") == []
    assert found("4300") == ["4300001"]
    exact = lambda q: [r.codigo_ibge for r in search.exact_matches(index, q).collect()]
    assert exact("são josé, SC") == ["4216602"] and len(exact("sao jose")) == 2 and exact("2605202") == ["2605202"]
    asked = spark.createDataFrame([("sao jose",), ("Sao Jose, sp",), ("nada",)], "q string")
    got = {r.q: (r.matches, r.resolved) for r in search.resolve_queries(index, asked, "q").collect()}
    assert got == {"sao jose": (2, None), "Sao Jose, sp": (1, "3549904"), "nada": (0, None)}


def test_csv_with_json_columns_and_slices(spark, tmp_path):
    df = spark.createDataFrame([("1", [("a", 2)], None), ("2", None, 3)], "k string, types array<struct<t: string, n: int>>, v int")
    writers.write_csv(df, str(tmp_path / "c"), json_columns=["types"])
    back = {r.k: (r.types, r.v) for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).collect()}
    assert back["1"] == ('[{"t":"a","n":2}]', None) and back["2"][1] == "3"
    dim = spark.createDataFrame([("1", "Um"), ("2", "Dois")], "k string, name string")
    writers.write_slice(df.drop("types"), dim, "k", ["name"], F.col("v") == 3, str(tmp_path / "s"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "s")).collect()] == [("Dois", "3")]


def test_failed_writes_leave_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_parquet(spark.range(3), path)
    with pytest.raises(Exception):
        writers.write_parquet(spark.range(3).select(F.raise_error(F.lit("boom"))), path)
    assert spark.read.parquet(path).count() == 3
    assert writers.archive_release(spark.range(3), str(tmp_path / "h"), "r1")
    assert not writers.archive_release(spark.range(9), str(tmp_path / "h"), "r1")
    assert spark.read.parquet(str(tmp_path / "h")).filter("source_release = 'r1'").count() == 3


def test_ordered_parquet_files_do_not_overlap(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    rows = [(i * 7919 % 1000, None if i == 5 else f"v{i % 13:02}") for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, v string").repartition(3)
    path = str(tmp_path / "ordered")
    writers.write_ordered_parquet(df, path, ["v", "k"])
    files = [pq.read_table(f).to_pylist() for f in sorted(glob.glob(f"{path}/part-*"))]
    order = [((r["v"] is not None, r["v"] or ""), r["k"]) for f in files for r in f]
    assert len(order) == 1000 and order == sorted(order)
    writers.write_ordered_parquet(df.limit(0), path, ["v", "k"])
    assert spark.read.parquet(path).count() == 0


def test_the_driver_names_no_file_on_a_shared_disk(spark, tmp_path, monkeypatch):
    """As many files as rows: tasks write them, so that the driver's work does not grow with them."""
    from panelspark.sinks import writers

    monkeypatch.setattr(writers, "unquote", None)
    df = spark.createDataFrame([(f"b {k}.json", f"corpo ç {k}") for k in range(300)], "name string, body string")
    writers.write_named_texts(df.repartition(5), str(tmp_path / "out"), "name", "body")
    held = {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir() if not f.name.startswith(".")}
    assert held == {f"b {k}.json": f"corpo ç {k}\n".encode() for k in range(300)}
