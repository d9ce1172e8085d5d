"""Text, number and page functions, evidence and search over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import numbers as nu, text as tx
from panelspark.operators import evidence, search
from panelspark.queries.registry import query, table
from panelspark.sources.pages import harvest_links, harvest_table_rows, page_text, url_path

# SQL side of the accent folding; ß is the one letter of the texts that lower() leaves whole.
_FOLD = "replace(strip_accents(lower({c})), 'ß', 'ss')"


def documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text", "source")


def _fold(column):
    return _FOLD.format(c=column)


@query("name_normalise", f"""SELECT doc_id, md5(trim(regexp_replace({_fold('text')}, '\\s+', ' ', 'g'))) AS digest,
  length(trim(regexp_replace({_fold('text')}, '\\s+', ' ', 'g'))) AS chars FROM documents""")
def name_normalise(spark, folder):
    """Whole texts without accents and case, as digests."""
    name = tx.normalize_name(F.col("text"))
    return documents(spark, folder).select(
        "doc_id", F.md5(name.cast("binary")).alias("digest"), F.length(name).cast("bigint").alias("chars"))


@query("name_normalise_exact", f"""SELECT doc_id, md5(trim(regexp_replace({_fold('text')}, '\\s+', ' ', 'g'))) AS digest FROM documents""")
def name_normalise_exact(spark, folder):
    """The same through the all-scripts Arrow function."""
    return documents(spark, folder).select(
        "doc_id", F.md5(tx.normalize_exact("text").cast("binary")).alias("digest"))


@query("slug_normalise", f"""SELECT doc_id, md5(trim(regexp_replace({_fold('text')}, '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents""")
def slug_normalise(spark, folder):
    return documents(spark, folder).select(
        "doc_id", F.md5(tx.normalize_slug(F.col("text")).cast("binary")).alias("digest"))


@query("search_normalise", """SELECT doc_id, md5(trim(regexp_replace(strip_accents(lower(text)), '[,\\s]+', ' ', 'g'))) AS digest FROM documents""")
def search_normalise(spark, folder):
    return documents(spark, folder).select(
        "doc_id", F.md5(tx.normalize_search(F.col("text")).cast("binary")).alias("digest"))


@query("mention_join", f"""WITH d AS (SELECT doc_id, trim(regexp_replace({_fold('text')}, '[^a-z0-9]+', ' ', 'g')) AS t FROM documents),
  b AS (SELECT item_id, trim(regexp_replace({_fold('text')}, '[^a-z0-9]+', ' ', 'g')) AS p FROM benchmark)
  SELECT doc_id, item_id FROM d JOIN b ON contains(d.t, b.p)""")
def mention_join(spark, folder):
    """Documents that hold a benchmark passage, found through a shared run of words."""
    return evidence.mention_join(documents(spark, folder), "doc_id", "text",
                                 table(spark, folder, "benchmark"), "item_id", "text")


@query("keyword_rules", """SELECT doc_id, contains(lower(text), 'the') AND contains(lower(text), 'on') AND contains(lower(text), 'er') AS all_terms,
  ends_with(text, '.') OR ends_with(text, '!') AS any_suffix,
  CASE WHEN ends_with(source, '7') THEN '7' WHEN ends_with(source, '17') THEN '17' WHEN ends_with(source, '1') THEN '1' ELSE 'other' END AS label FROM documents""")
def keyword_rules(spark, folder):
    return documents(spark, folder).select(
        "doc_id", tx.contains_all(F.lower("text"), ("the", "on", "er")).alias("all_terms"),
        (F.col("text").endswith(".") | F.col("text").endswith("!")).alias("any_suffix"),
        evidence.first_suffix(F.col("source"), ("7", "17", "1"), "other").alias("label"))


@query("inactive_status", """SELECT conv_id, turn, contains(strip_accents(lower(text)), 'cancel') OR contains(strip_accents(lower(text)), 'anulad')
  OR contains(strip_accents(lower(text)), 'ele') AS inactive FROM conversations""")
def inactive_status(spark, folder):
    rows = table(spark, folder, "conversations")
    return rows.select("conv_id", "turn", (tx.is_inactive_status(F.col("text"))
                                           | tx.normalize_search(F.col("text")).contains("ele")).alias("inactive"))


def _grants(spark, folder):
    """Programmes, proposals and agreements in the shape of the transfer source."""
    part, orders = table(spark, folder, "part"), table(spark, folder, "orders")
    programs = part.select(
        F.col("p_partkey").cast("string").alias("ID_PROGRAMA"),
        F.when(F.col("p_size") < 15, "Prevenção e PREPARAÇÃO para desastres")
        .when(F.col("p_size") < 30, "Gestão de riscos e desastres").otherwise(F.col("p_name")).alias("NOME_PROGRAMA"),
        F.concat(F.lit("20"), F.when(F.col("p_type") == "PROMO", "00tk").when(F.col("p_type") == "ECONOMY", "8865")
                 .otherwise("9999")).alias("ACAO_ORCAMENTARIA"))
    links = table(spark, folder, "lineitem").select(
        F.col("l_partkey").cast("string").alias("ID_PROGRAMA"), F.col("l_orderkey").cast("string").alias("ID_PROPOSTA"))
    code = F.lpad(F.col("o_custkey").cast("string"), 7, "0")
    name = F.concat(F.lit("Unidade Ção "), F.col("o_custkey").cast("string"))
    proposals = orders.select(
        F.col("o_orderkey").cast("string").alias("ID_PROPOSTA"), code.alias("COD_MUNIC_IBGE"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Obra no Município de "), name, F.lit(".")))
        .when(F.col("o_orderstatus") == "P", F.concat(name, F.lit("/SC, obra"))).otherwise("outra obra").alias("OBJETO_PROPOSTA"),
        F.year("o_orderdate").cast("string").alias("ANO_PROP"), F.col("o_orderkey").alias("seq"))
    ev = table(spark, folder, "events")
    agreements = ev.select(
        F.col("event_id").cast("string").alias("ID_PROPOSTA"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("value") / 5).cast("string")).alias("NR_CONVENIO"),
        F.when(F.col("event_type") == "error", "").otherwise(
            (F.lit(1990) + F.pmod(F.col("event_id"), F.lit(30))).cast("string")).alias("ANO"),
        F.col("event_type").alias("SIT_CONVENIO"),
        F.concat(F.lit("1."), F.lpad(F.pmod(F.col("event_id"), F.lit(1000)).cast("string"), 3, "0"), F.lit(",25")).alias("VL_GLOBAL_CONV"),
        F.col("event_id").alias("seq"))
    units = table(spark, folder, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 7, "0").alias("code"),
        F.concat(F.lit("Unidade Ção "), F.col("c_custkey").cast("string")).alias("name"), F.lit("SC").alias("uf"))
    return programs, links, proposals, agreements, units


@query("evidence_attribution", """WITH prog AS (SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN '00TK' WHEN p_type = 'ECONOMY' THEN '8865' ELSE 'prevenção/preparação' END AS action
    FROM part WHERE p_size < 15 OR (p_size < 30 AND p_type IN ('PROMO', 'ECONOMY'))),
  lab AS (SELECT DISTINCT l_orderkey AS prop, action FROM lineitem JOIN prog ON p_partkey = l_partkey),
  prop AS (SELECT o_orderkey AS prop, o_custkey AS unit, year(o_orderdate) AS py, o_orderstatus AS st FROM orders WHERE o_orderkey IN (SELECT prop FROM lab)),
  texts AS (SELECT *, CASE st WHEN 'F' THEN 'Obra no Município de Unidade Ção ' || unit || '.' WHEN 'P' THEN 'Unidade Ção ' || unit || '/SC, obra' ELSE 'outra obra' END AS object FROM prop),
  men AS (SELECT t.* FROM texts t JOIN customer ON c_custkey = t.unit WHERE t.st IN ('F', 'P')),
  ag AS (SELECT e.event_id AS seq, e.user_id || '-' || CAST(floor(e.value / 5) AS BIGINT) AS number, CASE WHEN e.event_type = 'error' THEN 0 ELSE 1990 + e.event_id % 30 END AS own,
     e.event_type AS status, 1000 + e.event_id % 1000 + 0.25 AS gv, m.unit, m.prop, m.py, m.object FROM events e JOIN men m ON m.prop = e.event_id),
  kept AS (SELECT * EXCLUDE (k), CASE WHEN own <> 0 THEN own ELSE py END AS year FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY seq) AS k FROM ag) WHERE k = 1),
  act AS (SELECT unit, string_agg(DISTINCT action, '|' ORDER BY action) AS actions FROM kept JOIN lab USING (prop) GROUP BY unit)
  SELECT lpad(CAST(k.unit AS VARCHAR), 7, '0') AS code, count(*) AS agreements, CAST(min(year) AS BIGINT) AS first_year, CAST(max(year) AS BIGINT) AS last_year,
    any_value(act.actions) AS actions, arg_max(number, (year, seq)) AS latest_number, arg_max(status, (year, seq)) AS latest_status,
    arg_max(object, (year, seq)) AS latest_object, CAST(arg_max(gv, (year, seq)) AS DOUBLE) AS latest_value
  FROM kept k JOIN act USING (unit) GROUP BY k.unit""")
def evidence_attribution(spark, folder):
    """Programme to proposal to agreement chain attributed to units by mention."""
    result = evidence.attribute_transfers(*_grants(spark, folder))
    return result.select("code", "agreements", "first_year", "last_year", F.array_join("actions", "|").alias("actions"),
                         F.col("latest.number").alias("latest_number"), F.col("latest.status").alias("latest_status"),
                         F.col("latest.object").alias("latest_object"), F.col("latest.globalValue").alias("latest_value"))


def _index(spark, folder):
    return table(spark, folder, "customer").select(
        F.concat(F.lit("São "), F.col("c_name")).alias("municipio"), F.substring("c_mktsegment", 1, 2).alias("uf"),
        F.lpad(F.col("c_custkey").cast("string"), 7, "0").alias("codigo_ibge"), "c_custkey")


@query("search_units", """SELECT lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS codigo_ibge, 'São ' || c_name AS municipio FROM customer
  WHERE contains('sao ' || lower(c_name) || ' ' || lower(substr(c_mktsegment, 1, 2)) || ' ' || lpad(CAST(c_custkey AS VARCHAR), 7, '0'), 'sao customer#00000')
  ORDER BY c_custkey LIMIT 50""")
def search_units(spark, folder):
    """Typed search: first fifty matches in source order."""
    return search.search_units(_index(spark, folder), "  SÃO,  customer#00000 ", position="c_custkey").select(
        "codigo_ibge", "municipio")


@query("search_state", """SELECT lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS codigo_ibge FROM customer
  WHERE lower(substr(c_mktsegment, 1, 2)) = 'bu' ORDER BY c_custkey LIMIT 50""")
def search_state(spark, folder):
    """A two-letter query that is a state code lists the state."""
    return search.search_units(_index(spark, folder), "Bu", position="c_custkey").select("codigo_ibge")


@query("resolve_exact", """WITH q AS (SELECT s_suppkey, 'SAO  customer#' || substr(s_name, 10) AS query FROM supplier
    UNION ALL SELECT s_suppkey + 1000000, lpad(CAST(s_suppkey AS VARCHAR), 7, '0') FROM supplier
    UNION ALL SELECT s_suppkey + 2000000, 'nowhere ' || s_suppkey FROM supplier)
  SELECT q.s_suppkey AS asked, CASE WHEN q.s_suppkey < 2000000 THEN lpad(CAST(q.s_suppkey % 1000000 AS VARCHAR), 7, '0') END AS resolved,
    CAST(CASE WHEN q.s_suppkey < 2000000 THEN 1 ELSE 0 END AS BIGINT) AS matches FROM q""")
def resolve_exact(spark, folder):
    """A table of typed queries resolved to units; only unique matches resolve."""
    sup = table(spark, folder, "supplier")
    key = F.col("s_suppkey")
    asked = (sup.select(key.alias("asked"), F.concat(F.lit("SAO  customer#"), F.substring("s_name", 10, 9)).alias("query"))
             .unionByName(sup.select((key + 1000000).alias("asked"), F.lpad(key.cast("string"), 7, "0").alias("query")))
             .unionByName(sup.select((key + 2000000).alias("asked"), F.concat(F.lit("nowhere "), key.cast("string")).alias("query"))))
    return search.resolve_queries(_index(spark, folder), asked, "query").select("asked", "resolved", "matches")


@query("locale_numbers", """SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS amount, CAST(round_even(o_totalprice, 0) AS BIGINT) AS whole,
  CAST(NULL AS DOUBLE) AS bad_amount, CAST(0 AS BIGINT) AS bad_whole, o_totalprice AS plain, CAST(NULL AS DOUBLE) AS not_plain FROM orders""")
def locale_numbers(spark, folder):
    """Prices written in the local notation and read back; text that is no number."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    local = F.replace(F.replace(F.replace(F.format_number(price, 2), F.lit(","), F.lit("_")), F.lit("."), F.lit(",")), F.lit("_"), F.lit("."))
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), local.alias("local"), F.replace(price.cast("string"), F.lit("."), F.lit(",")).alias("comma"),
        price.cast("string").alias("point"), "o_orderpriority")
    return rows.select(
        "id", nu.locale_decimal(F.col("local")).alias("amount"), nu.lenient_int(F.col("comma")).alias("whole"),
        nu.locale_decimal(F.col("o_orderpriority")).alias("bad_amount"), nu.lenient_int(F.col("o_orderpriority")).alias("bad_whole"),
        nu.numeric_text(F.col("point")).alias("plain"), nu.numeric_text(F.col("comma")).alias("not_plain"))


@query("census_indicator", """SELECT c_custkey AS id, c_name AS name, upper(substr(c_mktsegment, 1, 2)) AS uf,
  CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS connected,
  CASE WHEN c_acctbal >= 0 THEN round(100 - c_acctbal, 2) END AS outside FROM customer""")
def census_indicator(spark, folder):
    """Label split, numeric-text guard (negative values are no plain number) and complement."""
    rows = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat_ws(" - ", F.col("c_name"), F.upper(F.substring("c_mktsegment", 1, 2))).alias("label"),
        F.when(F.col("c_acctbal") < 0, "-").otherwise(
            F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("v"))
    name, uf = tx.split_label(F.col("label"))
    value = nu.numeric_text(F.col("v"))
    return rows.select("id", name.alias("name"), uf.alias("uf"), F.round(value, 2).alias("connected"),
                       nu.complement_pct(value).alias("outside"))


@query("excel_serial", """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(NULL AS DATE) AS bad FROM orders""")
def excel_serial(spark, folder):
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date"))
    serial = (days + F.lit(0.75)).cast("string")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), nu.serial_to_date(serial).alias("day"),
        F.year(nu.serial_to_date(serial)).alias("year"), nu.serial_to_date(F.col("o_orderpriority")).alias("bad"))


@query("release_name_parse", """SELECT o_orderkey AS id, CAST(year(o_orderdate) - 10 AS INTEGER) AS first_year, CAST(year(o_orderdate) AS INTEGER) AS latest_year,
  'v' || (o_orderkey % 5) || '.' || (o_orderkey % 3) AS version, CAST(o_orderdate AS DATE) AS official_date FROM orders""")
def release_name_parse(spark, folder):
    day = F.to_date("o_orderdate")
    name = F.format_string("files/BD_Atlas_%d_%d_V%d.%d_%s_Consolidado.csv", F.year(day) - 10, F.year(day),
                           F.col("o_orderkey") % 5, F.col("o_orderkey") % 3, F.date_format(day, "yyyy.MM-dd"))
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), tx.parse_release_name(name).alias("r")).select("id", "r.*")


@query("long_date_parse", """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, 'v' || (o_orderkey % 4) AS version FROM orders""")
def long_date_parse(spark, folder):
    names = F.array(*[F.lit(m) for m in ("Janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho",
                                         "agosto", "setembro", "outubro", "novembro", "dezembro")])
    day = F.to_date("o_orderdate")
    text = F.concat(F.lit("Tabela V"), (F.col("o_orderkey") % 4).cast("string"), F.lit(", "), F.dayofmonth(day).cast("string"),
                    F.lit(" de "), F.element_at(names, F.month(day)), F.lit(" de "), F.year(day).cast("string"))
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), tx.parse_long_date(text).alias("day"), tx.parse_version(text).alias("version"))


@query("code_levels", """SELECT p_partkey AS id, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS code, substr(lpad(CAST(p_partkey AS VARCHAR), 9, '0'), 1, 1) AS category,
  substr(lpad(CAST(p_partkey AS VARCHAR), 9, '0'), 1, 2) AS grp, substr(lpad(CAST(p_partkey AS VARCHAR), 9, '0'), 1, 3) AS subgroup FROM part""")
def code_levels(spark, folder):
    from panelspark.operators.conform import code_levels as levels

    level = levels(F.col("p_partkey"), 9)
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), level["code"].alias("code"), level["category"].alias("category"),
        level["group"].alias("grp"), level["subgroup"].alias("subgroup"))


@query("json_flatten", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  json_extract_string(props, '$.absent.deep') AS optional FROM events""")
def json_flatten(spark, folder):
    """A required path and an optional one out of nested JSON text."""
    from panelspark.sources.contracts import require

    parsed = F.from_json("props", "k bigint, absent struct<deep: string>")
    return table(spark, folder, "events").select("event_id", parsed.alias("p")).select(
        "event_id", require(F.col("p.k"), "k").alias("k"), F.col("p.absent.deep").alias("optional"))


@query("link_harvest", """WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages)
  SELECT page_id, len(hrefs) AS links, len(list_distinct(hrefs)) AS distinct_links, list_min(hrefs) AS first_href FROM a WHERE len(hrefs) > 0""")
def link_harvest(spark, folder):
    """Links of every page, whole pages parsed where they lie."""
    links = harvest_links(table(spark, folder, "pages"))
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("href").alias("distinct_links"),
                                        F.min("href").alias("first_href"))


@query("page_facts", """SELECT page_id, lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z]+://[^/]*', '')) AS path,
  regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS chars FROM pages""")
def page_facts(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", url_path(F.col("url")).alias("path"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"),
        F.length(page_text(F.col("html"))).cast("bigint").alias("chars"))


@query("table_row_harvest", """SELECT c_custkey AS page_id, n AS row_idx, CASE n WHEN 0 THEN 'head' ELSE 'body' END AS kind,
  CASE n WHEN 0 THEN 'Name|Segment' ELSE c_name || '|' || c_mktsegment || ' a' END AS cells, CAST(n AS INTEGER) AS links FROM customer, range(0, 2) t(n)""")
def table_row_harvest(spark, folder):
    """Table rows of pages written from the customers, with attributes, cells and links."""
    pages = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("page_id"),
        F.concat(F.lit('<table><tr data-kind="head"><th>Name</th><th> Segment </th></tr><tr data-kind="body"><td>'), F.col("c_name"),
                 F.lit("</td><td>"), F.col("c_mktsegment"), F.lit(' <a href="/x" title="Baixar">a</a></td></tr></table>')).alias("html"))
    rows = harvest_table_rows(pages)
    return rows.select("page_id", "row_idx", F.element_at("attrs", F.lit("data-kind")).alias("kind"),
                       F.array_join("cells", "|").alias("cells"), F.size("links").alias("links"))
