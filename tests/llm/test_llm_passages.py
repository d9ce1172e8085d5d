import re

from llm_cases import CLASHING, awkward, proposals, words_of
from panelspark.llm.passages import PARAGRAPH, UNIT, kept_text, repeated_passages


def brute(rows, unit):
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    first, out = {}, {}
    for i, t in docs:
        units = [(m.start(), m.end(), tuple(words_of(m.group()))) for m in unit.finditer(t)]
        gone = []
        for start, end, words in units:
            if len(words) >= 5 and first.setdefault(words, (i, start)) != (i, start):
                gone.append((start, end))
        kept = "".join(c for k, c in enumerate(t) if not any(a <= k < b for a, b in gone))
        out[(i, t)] = (len(units), len(gone), sum(b - a for a, b in gone), kept)
    return out


def check(spark, unit, least):
    rows = [r for r in awkward() if r[0] not in (None, 50, 51, 500)]
    found = repeated_passages(proposals(spark, rows, CLASHING), unit=unit).collect()
    texts = dict(rows)
    spans = spark.createDataFrame([(texts[r.ID_PROPOSTA] or "", r.removed, r.ID_PROPOSTA) for r in found],
                                  "text string, removed array<struct<start:long,end:long>>, id long")
    kept = {r.id: r.kept for r in spans.select("id", kept_text("text", "removed").alias("kept")).collect()}
    got = {(r.ID_PROPOSTA, texts[r.ID_PROPOSTA] or ""): (r.n_units, r.n_removed, r.chars_removed, kept[r.ID_PROPOSTA]) for r in found}
    assert got == brute(rows, unit)
    assert len(found) == len(rows) and sum(r.n_removed for r in found) > least


def test_sentences_against_brute_force(spark):
    check(spark, UNIT, 10)


def test_paragraphs_against_brute_force(spark):
    check(spark, PARAGRAPH, 3)


def test_whole_text_is_cut_without_gaps():
    for _, text in awkward():
        for unit in (UNIT, PARAGRAPH):
            assert "".join(re.findall(unit, text or "")) == (text or "")


def test_equal_rows_and_null_ids(spark):
    rows = [(1, "uma obra de drenagem na rua."), (1, "uma obra de drenagem na rua."), (None, "uma obra de drenagem na rua!")]
    got = sorted((r.ID_PROPOSTA or 0, r.n_removed) for r in repeated_passages(proposals(spark, rows)).collect())
    assert got == [(0, 0), (1, 1), (1, 1)]
    assert repeated_passages(proposals(spark, [])).collect() == []


def test_whole_lines_of_any_length(spark):
    rows = [(1, "All rights reserved\nOutra linha"), (2, "texto novo\nall RIGHTS reserved!\nfim"), (3, "Não. Sim. Talvez. Nunca. Já.\n!!!"),
            (4, "não sim talvez nunca já\n!!!"), (5, "uma obra de drenagem na rua. Fim da lista."), (6, "uma obra de drenagem na rua. Outra."),
            (7, "uma obra de drenagem na rua. Outra.")]
    df = proposals(spark, rows)
    found = repeated_passages(df, whole_lines=True)
    out = {r.id: (r.kept, r.chars_removed) for r in df.withColumnRenamed("ID_PROPOSTA", "id").join(
        found.withColumnRenamed("ID_PROPOSTA", "id"), "id").select("id", "chars_removed", kept_text("OBJETO_PROPOSTA", "removed").alias("kept")).collect()}
    assert out == {1: (rows[0][1], 0), 2: ("texto novo\nfim", 21), 3: (rows[2][1], 0), 4: ("!!!", 24), 5: (rows[4][1], 0),
                   6: (" Outra.", 28), 7: ("", 35)}
