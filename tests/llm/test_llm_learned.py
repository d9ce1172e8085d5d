"""Toxicity and quality: held-out accuracy and awkward rows."""

import pytest
from pyspark.sql import functions as F

from llm_cases import CLASHING, awkward, proposals
from panelspark.llm.quality import fit_trees, proposal_quality
from panelspark.llm.queries import QUERIES
from panelspark.llm.toxicity import proposal_toxicity

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name, label, least", [("op2_toxicity", "toxic", 0.95), ("op7_quality", "quality", 0.98)])
def test_held_out_accuracy(spark, name, label, least):
    scored = QUERIES[name](spark, FOLDER)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.filter("held_out").join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").collect()
    assert len(rows) > 500
    assert sum(r.predicted == r[label] for r in rows) / len(rows) >= least
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("operator", [proposal_toxicity, proposal_quality])
def test_awkward_rows_and_labels(spark, operator):
    rows = awkward()
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (41, None), (42, 7), (1, 1), (9999, 1)],
                                   "ID_PROPOSTA long, label int")
    df = proposals(spark, rows, CLASHING)
    once = sorted(((r.ID_PROPOSTA, r.score) for r in operator(df, labels).collect()), key=repr)
    again = sorted(((r.ID_PROPOSTA, r.score) for r in operator(df.repartition(5), labels).collect()), key=repr)
    assert once == again and len(once) == len(rows)
    assert all(0 <= s <= 1 for _, s in once)


@pytest.mark.parametrize("operator", [proposal_toxicity, proposal_quality])
def test_no_labels_and_no_rows(spark, operator):
    none = spark.createDataFrame([], "ID_PROPOSTA long, label int")
    assert {r.score for r in operator(proposals(spark, [(1, "obra"), (2, None)]), none).collect()} == {0.5}
    assert operator(proposals(spark, []), none).collect() == []


def test_trees_separate_what_one_cut_or_two_can():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.3)).astype(float)
    model = fit_trees(x, y)
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.97


def test_query_columns_on_the_smallest_tables(spark):
    held = QUERIES["op7_quality"](spark, "/root/testdata/sf0.001").select(F.sum(F.col("held_out").cast("int"))).first()[0]
    assert 10 < held < 90
