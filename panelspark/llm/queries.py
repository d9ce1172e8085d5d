"""One query per operator over the driver tables.

Each query names the columns of the given tables as the operator's interface expects them, applies
the operator to the whole table and names the results as the contract asks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.llm.bpe import count_proposal_tokens
from panelspark.llm.common import read_table, stage_table
from panelspark.llm.decontaminate import find_evaluation_items
from panelspark.llm.histories import history_steps, history_trie
from panelspark.llm.lines import repeated_lines
from panelspark.llm.mixing import mix_narratives
from panelspark.llm.negatives import hard_negatives
from panelspark.llm.pages import main_text
from panelspark.llm.passages import repeated_passages
from panelspark.llm.quality import proposal_quality
from panelspark.llm.simhash import link_similar_proposals
from panelspark.llm.suffixes import repeated_bytes
from panelspark.llm.topk import nearest_profiles
from panelspark.llm.toxicity import proposal_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def proposals(spark: SparkSession, folder: str) -> DataFrame:
    """The documents in the role of transfer proposals: an id and the text of its object."""
    return read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("ID_PROPOSTA"), F.col("text").alias("OBJETO_PROPOSTA"))


def whole_profiles(embeddings: DataFrame) -> DataFrame:
    """Rows whose vectors are finite throughout, with the whole numbers that a profile is made of."""
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    return embeddings.filter(F.col("embedding").isNotNull() & finite).withColumn("perfil", whole)


def held_out() -> Column:
    """Rows that are never learnt from; a null id is not one of them."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_labels(spark: SparkSession, folder: str, label: str) -> DataFrame:
    """Labels of the rows that may be learnt from."""
    return (read_table(spark, folder, "labels").filter(~held_out())
            .select(F.col("doc_id").alias("ID_PROPOSTA"), F.col(label).alias("label")))


def judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(F.col("ID_PROPOSTA").alias("doc_id"), "score").select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op1_topk", sql="""
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)]), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5""")
def op1_topk(spark, folder):
    units = whole_profiles(read_table(spark, folder, "embeddings")).select(F.col("vec_id").alias("codigo_ibge"), "perfil")
    best = nearest_profiles(units, units.filter(F.col("codigo_ibge") % 50 == 0))
    return best.select(F.col("query").alias("query_id"), "rank", F.col("codigo_ibge").alias("vec_id"), "score")


@query("op2_toxicity")
def op2_toxicity(spark, folder):
    scored = proposal_toxicity(proposals(spark, folder), training_labels(spark, folder, "toxic"))
    return judged(scored, 0.5)


@query("op3_token_counts")
def op3_token_counts(spark, folder):
    import public_tokenizers

    counted = count_proposal_tokens(proposals(spark, folder), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumnRenamed("ID_PROPOSTA", "doc_id")


@query("op4_simhash")
def op4_simhash(spark, folder):
    linked = link_similar_proposals(proposals(spark, folder))
    return linked.select(F.col("ID_PROPOSTA").alias("doc_id"),
                         F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
                         F.col("component").alias("component_id"))


@query("op5_lines")
def op5_lines(spark, folder):
    found = repeated_lines(proposals(spark, folder))
    return found.select(F.col("ID_PROPOSTA").alias("doc_id"), "n_lines", F.size("removed").cast("long").alias("n_removed"),
                        F.array_join("removed", ",").alias("removed_lines"))


@query("op6_suffixes", sql="""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS g FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
f AS (SELECT g, min(doc_id) AS m FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
h AS (SELECT w.doc_id, w.i FROM w JOIN f USING (g) WHERE f.m < w.doc_id),
o AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM h),
u AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM u GROUP BY doc_id, run),
p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start FROM r),
k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS stop,
    string_agg(substr(d.x, 2 * p.start + 1, 2 * (p.a - p.start)), '' ORDER BY p.a) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""")
def op6_suffixes(spark, folder):
    found = repeated_bytes(proposals(spark, folder))
    return found.select(
        F.col("ID_PROPOSTA").alias("doc_id"), "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_quality")
def op7_quality(spark, folder):
    scored = proposal_quality(proposals(spark, folder), training_labels(spark, folder, "quality"))
    return judged(scored, 0.3)


@query("op8_mixing", sql=r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
  source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS wanted FROM s),
l AS (SELECT *, (wanted - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, (SELECT arg_min(level, cap / weight) FROM l WHERE cap > level * weight) AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END AS target FROM f),
r AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0 ELSE least(target / source_size, 2.0) END AS rate FROM t),
c AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.rate, CAST(floor(r.rate) AS INTEGER)
  + CASE WHEN CAST(('0x' || substr(md5('mix-1|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE
    < r.rate - floor(r.rate) THEN 1 ELSE 0 END AS copies FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, copies, size * copies AS taken FROM c""")
def op8_mixing(spark, folder):
    events = read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("Protocolo_S2iD"), F.col("source").alias("regiao"), F.col("text").alias("DH_Descricao"))
    return mix_narratives(events).withColumnRenamed("Protocolo_S2iD", "doc_id")


def _passage_columns(found: DataFrame) -> DataFrame:
    spans = F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return found.select(F.col("ID_PROPOSTA").alias("doc_id"), "n_units", "n_removed", "chars_removed",
                        F.array_join(spans, ",").alias("removed"))


@query("op9_passages", sql=r"""
WITH c AS (SELECT doc_id, 's' AS kind, 5 AS least, regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?\n]*|[.!?\n]+') AS p FROM documents
  UNION ALL SELECT doc_id, 'l', 1, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') FROM documents),
u AS (SELECT doc_id, kind, least, CAST(sum(length(piece)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop, length(piece) AS size,
    trim(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS norm
  FROM (SELECT doc_id, kind, least, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS i FROM c)),
r AS (SELECT *, stop - size AS start, row_number() OVER (PARTITION BY kind, norm ORDER BY doc_id, stop) AS place FROM u
  WHERE norm <> '' AND len(string_split(norm, ' ')) >= least),
x AS (SELECT doc_id, CAST(count(DISTINCT (start, stop)) AS BIGINT) AS n_removed FROM r WHERE place > 1 GROUP BY doc_id),
g AS (SELECT doc_id, start, stop, CASE WHEN start <= max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  THEN 0 ELSE 1 END AS opens FROM r WHERE place > 1),
h AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM g),
j AS (SELECT doc_id, run, min(start) AS start, max(stop) AS stop FROM h GROUP BY doc_id, run),
k AS (SELECT doc_id, CAST(sum(stop - start) AS BIGINT) AS chars_removed, string_agg(start || '-' || stop, ',' ORDER BY start) AS removed FROM j GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_units FROM u GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(chars_removed, 0) AS chars_removed,
  coalesce(removed, '') AS removed
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN k USING (doc_id)""")
def op9_passages(spark, folder):
    return _passage_columns(repeated_passages(proposals(spark, folder), whole_lines=True))


@query("op10_decontamination", sql=r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
occ AS (SELECT p.doc_id, p.i, l.n, array_to_string(list_slice(p.w, p.i, p.i + l.n - 1), ' ') AS g FROM pos p, lens l WHERE p.i + l.n - 1 <= len(p.w)),
hit AS (SELECT o.doc_id, o.i, o.n, win.item_id FROM occ o JOIN win ON o.n = win.n AND o.g = win.g),
nh AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)""")
def op10_decontamination(spark, folder):
    found = find_evaluation_items(proposals(spark, folder), read_table(spark, folder, "benchmark"))
    return found.select(F.col("ID_PROPOSTA").alias("doc_id"), "n_words", "n_hit",
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op11_pages", sql=r"""
WITH a AS (SELECT page_id, url, coalesce(html, '') AS html, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body,
    regexp_extract(lower(coalesce(url, '')), '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages),
t AS (SELECT page_id, url, array_to_string([b FOR b IN [trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&nbsp;', ' '), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))
    FOR x IN string_split_regex(body, '</?(?:p|h1)>')] IF b <> ''], chr(10) || chr(10)) AS text FROM a),
f AS (SELECT DISTINCT page_id, url, host, regexp_extract_all(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?s)<head>.*</head>|<article>.*</article>', ' ', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '[^\x20\x09-\x0D]+') AS w FROM a),
g AS (SELECT page_id, url, host, i, list_slice(w, i, i + 3) AS run FROM (SELECT *, unnest(range(1, len(w) - 2)) AS i FROM f)),
s AS (SELECT host, run FROM g GROUP BY host, run HAVING min(url) < max(url)),
n AS (SELECT page_id, url, CAST(count(DISTINCT place) AS BIGINT) AS n FROM (SELECT page_id, url, unnest(range(i, i + 4)) AS place FROM g JOIN s USING (host, run)) GROUP BY page_id, url)
SELECT t.page_id, t.url, t.text, CAST(length(t.text) AS BIGINT) AS n_chars, coalesce(n.n, 0) AS n_boilerplate FROM t LEFT JOIN n USING (page_id, url)""")
def op11_pages(spark, folder):
    return main_text(read_table(spark, folder, "pages"))


def _led_alike(steps: DataFrame, units: DataFrame) -> DataFrame:
    """Steps of every unit u after its first h are led by the first h steps of unit u - u % 20; h is crc32(u) % 4."""
    lead = units.select("unit", (F.col("unit") - F.col("unit") % 20).alias("led_by"),
                        (F.crc32(F.col("unit").cast("string").cast("binary")) % 4).alias("h"))
    first = steps.filter((F.col("unit") % 20 == 0) & (F.col("place") <= 3)).withColumnRenamed("unit", "led_by")
    first = lead.join(first, "led_by").filter(F.col("place") <= F.col("h")).select("unit", "place", "step", "words")
    taken = lead.join(first.groupBy("unit").agg(F.count("*").alias("taken")), "unit", "left")
    own = steps.join(taken, "unit").filter(F.col("place") > F.col("h")).select(
        "unit", (F.col("place") - F.col("h") + F.coalesce("taken", F.lit(0))).alias("place"), "step", "words")
    return first.unionByName(own)


@query("op12_histories", sql=r"""
WITH o AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''),
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
c AS (SELECT *, [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')] AS bytes FROM o),
h AS (SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295, bytes), lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h FROM c),
r AS (SELECT a.conv_id, list_concat(coalesce(list_slice(b.own, 1, a.h), []), list_slice(a.own, a.h + 1, len(a.own))) AS seq
  FROM h a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % 20),
p AS (SELECT conv_id, d, list_slice(seq, 1, d) AS k, len(seq) AS n FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM r)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM p GROUP BY k, d),
m AS (SELECT n.*, f.conv_id AS parent_conv_id, CASE WHEN n.d = 0 THEN 0 ELSE coalesce(len(regexp_extract_all(n.k[n.d].x, '[^\x20\x09-\x0D]+')), 0) END AS words
  FROM n LEFT JOIN n f ON n.d > 0 AND f.d = n.d - 1 AND f.k = list_slice(n.k, 1, n.d - 1)),
c2 AS (SELECT parent_conv_id, d - 1 AS d, count(*) AS n_children FROM m WHERE d > 0 GROUP BY ALL),
q AS (SELECT m.*, coalesce(c2.n_children, 0) AS n_children FROM m LEFT JOIN c2 ON c2.parent_conv_id = m.conv_id AND c2.d = m.d),
s AS (SELECT p.k, p.d, sum(CASE WHEN q.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((q.n_convs - 1) * q.words) AS saved FROM q JOIN p ON p.conv_id = q.conv_id AND p.d <= q.d GROUP BY p.k, p.d)
SELECT q.conv_id, CAST(q.d AS BIGINT) AS depth, q.parent_conv_id, q.n_convs, q.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, q.ends AS ends_sha256 FROM q JOIN s ON s.k = q.k AND s.d = q.d""")
def op12_histories(spark, folder):
    held = read_table(spark, folder, "conversations").select(
        F.col("conv_id").alias("codigo_ibge"), F.col("turn").alias("event_date"), F.col("role").alias("cobrade_code"),
        F.col("text").alias("human_damage_description"))
    steps = stage_table(history_steps(held))
    units = steps.select("unit").distinct()
    trie = history_trie(_led_alike(steps, units), units)
    return trie.select(F.col("unit").alias("conv_id"), "depth", F.col("parent_unit").alias("parent_conv_id"),
                       F.col("n_units").alias("n_convs"), "n_children", "n_leaves", F.col("saved_words").alias("saved_tokens"),
                       F.col("ends").alias("ends_sha256"))


@query("op13_negatives", sql="""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS peer, CAST(coalesce(list_sum([z[1] * z[2] FOR z IN list_zip(a.v, c.v)]), 0) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
s AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM p WHERE peer),
n AS (SELECT s.anchor_id, s.id AS positive_id, p.id AS negative_id, s.score AS positive_score, p.score AS negative_score,
    row_number() OVER (PARTITION BY s.anchor_id, s.id ORDER BY p.score DESC, p.id) AS rank
  FROM s JOIN p USING (anchor_id) WHERE s.place <= 5 AND NOT p.peer AND 80 * s.score <= 100 * p.score AND p.score <= s.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""")
def op13_negatives(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    units = whole_profiles(read_table(spark, folder, "embeddings")).select(
        F.col("vec_id").alias("codigo_ibge"), label.alias("codigo_regiao_imediata"), "perfil")
    mined = hard_negatives(units, units.filter(F.col("codigo_ibge") % 100 == 0))
    return mined.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank",
                        F.col("negative").alias("negative_id"), "positive_score", "negative_score")
