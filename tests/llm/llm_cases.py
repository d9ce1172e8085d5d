"""Proposal texts with the awkward cases: nulls, empty, long, repeated, near copies, rare characters."""

import random
import re

from pyspark.sql import types as T

PROPOSALS = T.StructType([T.StructField("ID_PROPOSTA", T.LongType()), T.StructField("OBJETO_PROPOSTA", T.StringType())])
#: Names that operators use inside, as extra columns of the input.
CLASHING = ("body", "node", "fp", "n", "tag", "digest", "size", "items", "score", "spans", "segment", "line")


def proposals(spark, rows, extra=()):
    df = spark.createDataFrame([tuple(r) for r in rows], PROPOSALS).repartition(3)
    for name in extra:
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def words_of(text):
    """Lower-cased runs of digits, letters and non-ASCII characters, by the definition."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def awkward(seed: int = 5, count: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    words = ["obra", "de", "contenção", "em", "encosta", "do", "município", "para", "ação", "drenagem", "São", "Paulo",
             "prevenção", "risco", "chuva", "ponte", "rua", "bairro", "centro", "ß", "日本", "X", "1", "22"]

    def sentence():
        return " ".join(rng.choice(words) for _ in range(rng.randint(3, 14))) + rng.choice([".", "!", "", " ..."])

    def text():
        return "\n".join(" ".join(sentence() for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 6)))

    rows = [(i, text()) for i in range(count)]
    base = text() + "\n" + text()
    shared = "Recuperação de pontes destruídas pelas chuvas e contenção de encostas no bairro central da cidade velha hoje"
    rows += [(100 + i, base) for i in range(5)]
    rows += [(200 + i, base.replace("de", "da", i)) for i in range(6)]
    rows += [(300 + i, f"{text()} {shared} {text()}") for i in range(4)]
    rows += [(400, None), (401, None), (402, ""), (403, ""), (404, " \n\t "), (405, "!!!"), (406, "obra"), (407, "obra"),
             (408, "OBRA"), (409, "a" * 5000), (410, "ab " * 4000), (411, shared), (412, "\n".join([shared] * 3)),
             (None, base), (None, "sem número"), (50, rows[50][1]), (51, "outro texto com o mesmo número")]
    rows.append((500, " ".join(rng.choice(words) for _ in range(20_000))))
    rng.shuffle(rows)
    return rows
