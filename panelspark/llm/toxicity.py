"""Toxicity of proposal texts: FTRL-proximal logistic regression over hashed word patterns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import labelled_sample, map_texts, text_or_empty, words_of

BITS = 20
SAMPLE = 20_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 0.01


class WordHashes(dict):
    """Hash of each word; emptied when full so that memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word)
        return value


def features(text: bytes | None, hashes: WordHashes, bits: int = BITS) -> np.ndarray:
    """Slots of every word, pair of neighbours and pair with one word between; repeats included."""
    words = words_of(text)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    mix, other = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    parts = [h * mix, (h[:-1] * mix + h[1:]) * other, (h[:-2] * other + h[2:]) * mix + np.uint64(1)]
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)


def train_ftrl(examples: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS,
               alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
    """(slots, weights, bias): the non-zero weights after per-coordinate updates with an L1 threshold.

    ``examples`` are the distinct slots of each text; the bias is the last slot, free of L1.
    """
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            at = np.append(examples[i], size)
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            cut = np.sign(zi) * l1
            cut[-1] = 0.0
            w = np.where(np.abs(zi) > np.abs(cut), (cut - zi) / ((beta + root) / alpha + l2), 0.0)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            z[at] = zi + g - (np.sqrt(ni + g * g) - root) / alpha * w
            n[at] = ni + g * g
    cut = np.sign(z) * l1
    cut[-1] = 0.0
    w = np.where(np.abs(z) > np.abs(cut), (cut - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    kept = np.flatnonzero(w[:-1])
    return kept, w[kept], float(w[-1])


def fit_toxicity(labelled: DataFrame, text: str = "OBJETO_PROPOSTA", label: str = "label",
                 bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights learnt from a bounded sample of labelled texts, in one task of bounded memory.

    Only the non-zero weights (at most 2**bits, in practice some thousands) come to the driver.
    """
    rows = labelled.select(text_or_empty(text).alias("body"), F.col(label).cast("double").alias("y"))

    def slots(batches):
        hashes = WordHashes()
        for batch in batches:
            found = [np.unique(features(t, hashes, bits)).astype("<i4").tobytes()
                     for t in batch.column(0).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], names=["slots", "y"])

    def train(batches):
        examples, labels = [], []
        for batch in batches:
            examples += [np.frombuffer(s, "<i4") for s in batch.column(0).to_pylist()]
            labels += batch.column(1).to_pylist()
        # Rows arrive in no fixed order; training must not depend on it.
        order = sorted(range(len(labels)), key=lambda i: (xxhash.xxh64_intdigest(examples[i].tobytes()), labels[i]))
        kept, weights, bias = train_ftrl([examples[i] for i in order], np.array(labels)[order], bits, epochs)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1)), pa.array(np.append(weights, bias))],
                                         names=["slot", "weight"])

    model = (rows.mapInArrow(slots, "slots binary, y double").repartition(1)
             .mapInArrow(train, "slot long, weight double").toPandas())
    kept = model[model.slot >= 0].sort_values("slot")
    return kept.slot.to_numpy(), kept.weight.to_numpy(), float(model[model.slot < 0].weight.sum())


def score_toxicity(proposals: DataFrame, model, id: str = "ID_PROPOSTA", text: str = "OBJETO_PROPOSTA",
                   bits: int = BITS) -> DataFrame:
    """``id`` and ``score`` in (0, 1) of every row's whole text; null and empty texts get the base score."""
    kept, weights, bias = model
    shared = proposals.sparkSession.sparkContext.broadcast((kept, weights))

    def score(texts):
        slots, values = shared.value
        table = np.zeros(1 << bits)
        table[slots] = values
        hashes, sums = WordHashes(), np.full(len(texts), bias)
        for i, t in enumerate(texts):
            found = features(t, hashes, bits)
            found = found[table[found] != 0]
            sums[i] += table[np.unique(found)].sum()
        return {"score": 1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35)))}

    return map_texts(proposals.select(F.col(id), text_or_empty(text).alias("body")), score, "score double")


def proposal_toxicity(proposals: DataFrame, labels: DataFrame, id: str = "ID_PROPOSTA",
                      text: str = "OBJETO_PROPOSTA", label: str = "label", sample: int = SAMPLE) -> DataFrame:
    """How likely each proposal text is toxic, learnt from labelled proposals.

    ``labels`` has ``id`` and ``label`` (0 or 1; other values and nulls are left out).  At most about
    ``sample`` labelled rows, taken by a hash of their id, are learnt from; texts are never cut.
    Returns ``id`` and ``score``, one row per input row.  Without usable labels every score is 0.5.
    Null and empty texts get the score of a text without any pattern.  The table of labels in the
    sample is bounded, so it is broadcast and no text is shuffled.
    """
    labelled = labelled_sample(proposals, labels, id, text, label, sample)
    return score_toxicity(proposals, fit_toxicity(labelled, text, label), id, text)
