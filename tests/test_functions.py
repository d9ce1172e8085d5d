import datetime as dt

import pytest
from pyspark.sql import Row, functions as F

from panelspark.functions import numbers as nu, states as st, text as tx


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], schema).select(column.alias("v")).first().v


NAMES = {"  São   Paulo  ": "sao paulo", "Boa Esperança do Norte": "boa esperanca do norte",
         "STRAẞE straße": "strasse strasse", "Ünïcodé Ñandú\tÇ": "unicode nandu c", "ﬁm ½": "fim 1⁄2",
         "éclair": "eclair", "": "", "İstanbul Ŀ": "istanbul l·"}


@pytest.mark.parametrize("raw,expected", NAMES.items())
def test_names_lose_accents_case_and_extra_blanks(spark, raw, expected):
    assert one(spark, tx.normalize_name(F.col("x")), x=raw) == expected
    assert one(spark, tx.normalize_exact(F.col("x")), x=raw) == expected


def test_exact_normalisation_covers_other_scripts(spark):
    assert one(spark, tx.normalize_exact(F.col("x")), x="ΣΊΣΥΦΟΣ Ёлка") == "σισυφοσ елка"
    assert one(spark, tx.normalize_exact(F.col("x")), x=None) is None


def test_folding_covers_every_assigned_code_point(spark):
    import sys
    import unicodedata

    chars = [c for c in map(chr, range(1, sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cs", "Cn", "Co")]
    lines = [("x" + "y".join(chars[i:i + 40]) + "z",) for i in range(0, len(chars), 40)]
    rows = spark.createDataFrame(lines, "x string").select(
        "x", tx.normalize_name(F.col("x")).alias("a"), tx.normalize_exact(F.col("x")).alias("b")).filter("a <> b").collect()
    assert rows == []
    assert one(spark, tx.normalize_name(F.col("x")), x="Ａcre Ⅷ 𝐑io ① 각") == "acre viii rio 1 \u1100\u1161\u11a8"


def test_slug_and_search_forms(spark):
    assert one(spark, tx.normalize_slug(F.col("x")), x=" Área: Nº 3 — d'Água! ") == "area no 3 d agua"
    assert one(spark, tx.normalize_search(F.col("x")), x="  São José,  SC ") == "sao jose sc"


@pytest.mark.parametrize("text,found", [
    ("Obras no Município de São João", True), ("município do sao joao e outros", True),
    ("município da São João", True), ("Defesa civil em São João/SC", True), ("São João", False),
    ("Município de São Joãozinho", True), ("município de Joinville", False)])
def test_mention_accepts_four_phrasings_as_substrings(spark, text, found):
    assert one(spark, tx.mentions_unit(F.col("t"), F.col("n"), F.col("u")), t=text, n="São João", u="SC") is found


def test_inactive_status(spark):
    for text, expected in (("Convênio CANCELADO", True), ("Anulado", True), ("Em execução", False)):
        assert one(spark, tx.is_inactive_status(F.col("x")), x=text) is expected


def test_label_split_takes_the_last_state(spark):
    name, uf = tx.split_label(F.col("x"))
    assert one(spark, F.concat_ws("|", name, uf), x="A - B - SC") == "A - B|SC"
    with pytest.raises(Exception, match="unexpected unit label"):
        one(spark, name, x="Blumenau")


def test_release_name(spark):
    got = one(spark, tx.parse_release_name(F.col("x")), x="BD_Atlas_1991_2025_V1.1_2026.08-06_Consolidado.csv")
    assert got == Row(first_year=1991, latest_year=2025, version="v1.1", official_date=dt.date(2026, 8, 6))
    with pytest.raises(Exception, match="release name not recognised"):
        one(spark, tx.parse_release_name(F.col("x")), x="other.csv")


def test_long_dates_and_versions(spark):
    assert one(spark, tx.parse_long_date(F.col("x")), x="v2 - 12 de agosto de 2026") == dt.date(2026, 8, 12)
    assert one(spark, tx.parse_long_date(F.col("x")), x="1 de MARÇO de 2020") == dt.date(2020, 3, 1)
    assert one(spark, tx.parse_long_date(F.col("x")), x="no date") is None
    with pytest.raises(Exception, match="month not recognised"):
        one(spark, tx.parse_long_date(F.col("x")), x="12 de foo de 2026")
    assert one(spark, tx.parse_version(F.col("x")), x="tabela V1.2 ok") == "v1.2"


@pytest.mark.parametrize("raw,expected", [("1.234,56", 1234.56), ("10", 10.0), ("", None), (None, None), ("abc", None)])
def test_locale_decimal(spark, raw, expected):
    assert one(spark, nu.locale_decimal(F.col("x")), x=raw) == expected


@pytest.mark.parametrize("raw,expected", [("2,5", 2), ("3.5", 4), ("-1,5", -2), ("", 0), (None, 0), ("x", 0),
                                          ("inf", 0), ("nan", 0), ("7", 7)])
def test_lenient_int_rounds_half_to_even(spark, raw, expected):
    assert one(spark, nu.lenient_int(F.col("x")), x=raw) == expected


def test_numeric_text_and_complement(spark):
    assert one(spark, nu.numeric_text(F.col("x")), x="67.62") == 67.62
    for bad in ("-", "...", "1.", "-3", "1e5", "3\n"):
        assert one(spark, nu.numeric_text(F.col("x")), x=bad) is None
    assert one(spark, nu.complement_pct(nu.numeric_text(F.col("x"))), x="67.62") == 32.38


def test_serial_dates(spark):
    assert one(spark, nu.serial_to_date(F.col("x")), x="45000.9") == dt.date(2023, 3, 15)
    assert one(spark, nu.serial_to_date(F.col("x")), x="n/a") is None


def test_days_with_and_without_leading_zeros(spark):
    assert one(spark, nu.parse_day(F.col("x")), x=" 7/1/1991 ") == dt.date(1991, 1, 7)
    assert one(spark, nu.parse_day(F.col("x")), x="07/01/1991") == dt.date(1991, 1, 7)
    with pytest.raises(Exception):
        one(spark, nu.parse_day(F.col("x")), x="31/02/2020")


def test_strict_casts_stop_the_job(spark):
    assert one(spark, nu.strict_count(F.col("x")), x=" 12 ") == 12
    for bad in ("", "1.5x"):
        with pytest.raises(Exception):
            one(spark, nu.strict_count(F.col("x")), x=bad)


def test_percentage_is_null_on_zero_base(spark):
    assert one(spark, nu.percentage(F.lit(1.0), F.lit(4.0))) == 25.0
    assert one(spark, nu.percentage(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, nu.pct_change(F.lit(3.0), F.lit(2.0))) == 50.0


def test_non_finite_numbers_are_refused(spark):
    assert one(spark, nu.json_number(F.lit(1.5))) == 1.5
    for bad in (float("inf"), float("nan")):
        with pytest.raises(Exception, match="non-finite"):
            one(spark, nu.json_number(F.lit(bad)))


@pytest.mark.parametrize("answer,state", [("Sim", "declared_yes"), (" NÃO ", "declared_no"), ("Recusa", "refused"),
                                          ("Não informou", "not_reported"), ("-", "not_applicable")])
def test_answers(spark, answer, state):
    assert one(spark, st.answer_state(F.col("x")), x=answer) == state


@pytest.mark.parametrize("answer", ["talvez", "", None])
def test_unknown_answers_stop_the_job(spark, answer):
    with pytest.raises(Exception, match="survey answer not recognised"):
        one(spark, st.answer_state(F.col("x")), x=answer)


@pytest.mark.parametrize("states,expected", [
    (["declared_no", "declared_yes", "refused"], "declared_yes"), (["declared_no", "declared_no"], "declared_no"),
    (["declared_no", "refused", "not_reported"], "refused"), (["not_reported", "unknown"], "not_reported"),
    (["unknown", "declared_no"], "unknown"), (["not_applicable", "declared_no"], "not_applicable"),
    ([], "not_applicable")])
def test_combined_states_follow_precedence(spark, states, expected):
    array = F.array(*[F.lit(s) for s in states]).cast("array<string>")
    assert one(spark, st.combine_states(array)) == expected


def test_workbook_text(spark):
    assert one(spark, tx.clean_workbook_text(F.col("x")), x="a_x000D_b_x0002_c") == "ab\u0002c"


def test_full_match_rejects_trailing_newline(spark):
    assert one(spark, tx.full_match(F.col("x"), "[0-9]{7}"), x="1234567") is True
    assert one(spark, tx.full_match(F.col("x"), "[0-9]{7}"), x="1234567\n") is False


def test_exact_folding_holds_few_texts_at_once(spark, monkeypatch):
    """As Python strings; the batch itself stays an Arrow array, sliced or not."""
    import pyarrow as pa

    from panelspark.functions import text as tx

    held = []

    class Watched:
        def __init__(self, values):
            self.values = values

        def __len__(self):
            return len(self.values)

        def slice(self, at, n):
            held.append(n)
            return self.values.slice(at, n)

    texts = ["  São  PAULO ", None, "", "straße"] * 200
    got = tx.normalize_exact.func(Watched(pa.array(texts)))
    assert got.to_pylist() == ["sao paulo", None, "", "strasse"] * 200 and max(held) <= 64
    assert tx.normalize_exact.func(pa.array([], pa.string())).to_pylist() == []
