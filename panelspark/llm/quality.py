"""Quality of proposal texts: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm.common import labelled_sample, map_texts, text_or_empty

SAMPLE = 20_000
BINS = 64
DEPTH = 4
TREES = 60
RATE = 0.2
SMOOTH = 1.0

_CLASSES = np.zeros((256, 8))
for _code in range(256):
    _char = chr(_code)
    _kind = (0 if "a" <= _char <= "z" else 1 if "A" <= _char <= "Z" else 2 if "0" <= _char <= "9"
             else 3 if _char == " " else 4 if _code in (10, 13) else 5 if _char in ".,;:?'\"-()"
             else 6 if _code < 128 else 7)
    _CLASSES[_code, _kind] = 1

STATISTICS = ("bytes", "words", "lower", "upper", "digit", "blank", "break", "mark", "symbol", "wide",
              "letters_per_word", "distinct_words", "repeated_neighbours", "distinct_bytes",
              "most_common_symbol", "single_letters", "capitalised", "marks_per_word", "lines", "distinct_lines")


def statistics(text: bytes | None) -> list[float]:
    """Whole-text statistics, all defined for empty texts."""
    text = text or b""
    size = max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = counts @ _CLASSES / size
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    symbols = counts * _CLASSES[:, 6]
    return [np.log1p(len(text)), np.log1p(len(words)), *shares,
            len(text) / n, len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
            np.count_nonzero(counts) / 256, symbols.max() / size,
            sum(map((1).__eq__, map(len, words))) / n, sum(map(bytes.istitle, words)) / n,
            (shares[5] + shares[6]) * size / n, np.log1p(len(lines)), len(set(lines)) / len(lines)]


class Trees:
    """Complete trees of one depth as flat arrays: node i of a level leads to 2i and 2i + 1 of the next."""

    def __init__(self, edges: np.ndarray, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.edges, self.base, self.feature, self.cut, self.leaf = edges, base, feature, cut, leaf

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for level in range(depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (bins[rows, feature[at]] > cut[at])
            total += leaf[node]
        return 1.0 / (1.0 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, bins: int = BINS, depth: int = DEPTH, trees: int = TREES,
              rate: float = RATE, smooth: float = SMOOTH) -> Trees:
    """Boost logistic trees on histograms of gradients; all nodes of a level are split at once."""
    n, d = x.shape
    steps = np.linspace(0, 1, bins + 1)[1:-1]
    edges = np.quantile(x, steps, axis=0).T if n else np.zeros((d, bins - 1))
    mean = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    model = Trees(edges, float(np.log(mean / (1 - mean))), *(np.zeros((trees, s), t) for s, t in (
        ((1 << depth) - 1, np.int64), ((1 << depth) - 1, np.int64), (1 << depth, np.float64))))
    if not n:
        return model
    binned = model.binned(x)
    columns = np.arange(d) * bins
    total = np.full(n, model.base)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 1 << level
            slot = (node[:, None] * (d * bins) + columns + binned).ravel()
            sums = [np.bincount(slot, np.repeat(v, d), width * d * bins).reshape(width, d, bins).cumsum(axis=2)
                    for v in (g, h)]
            (left_g, left_h), (all_g, all_h) = sums, (s[:, :, -1:] for s in sums)
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g ** 2 / (left_h + smooth) + right_g ** 2 / (right_h + smooth) - all_g ** 2 / (all_h + smooth)
            gain[(left_h < 0.1) | (right_h < 0.1)] = 0.0
            best = gain.reshape(width, -1).argmax(axis=1)
            feature, cut = best // bins, best % bins
            # A node without a gain sends all rows left.
            cut = np.where(gain.reshape(width, -1).max(axis=1) > 1e-6, cut, bins)
            at = slice(width - 1, 2 * width - 1)
            model.feature[t, at], model.cut[t, at] = feature, cut
            node = 2 * node + (binned[np.arange(n), feature[node]] > cut[node])
        leaf = rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + smooth)
        model.leaf[t] = leaf
        total += leaf[node]
    return model


def fit_quality(proposals: DataFrame, labels: DataFrame, id: str = "ID_PROPOSTA", text: str = "OBJETO_PROPOSTA",
                label: str = "label", sample: int = SAMPLE) -> Trees:
    """Trees learnt from a bounded sample of labelled texts; the driver gets their statistics only."""
    labelled = labelled_sample(proposals, labels, id, text, label, sample)
    rows = labelled.select(F.col(label).cast("double").alias("y"), text_or_empty(text).alias("body"))
    stats = map_texts(rows, lambda texts: {"x": [list(map(float, statistics(t))) for t in texts]},
                      "x array<double>").toPandas()
    x = np.array(stats.x.tolist()).reshape(len(stats), len(STATISTICS))
    y = stats.y.to_numpy(dtype=float)
    # Rows arrive in no fixed order; training must not depend on it.
    order = np.lexsort((y, *x.T)) if len(y) else []
    return fit_trees(x[order], y[order])


def quality_scores(spark: SparkSession, model: Trees):
    """What scores the whole texts of a batch with the broadcast arrays of ``model``."""
    shared = spark.sparkContext.broadcast((model.edges, model.base, model.feature, model.cut, model.leaf))

    def score(texts):
        x = np.array([statistics(t) for t in texts]).reshape(len(texts), -1)
        return {"stage_score": Trees(*shared.value).score(x)}

    return score


def proposal_quality(proposals: DataFrame, labels: DataFrame, id: str = "ID_PROPOSTA",
                     text: str = "OBJETO_PROPOSTA", label: str = "label", sample: int = SAMPLE) -> DataFrame:
    """How likely each proposal text is of good quality, learnt from labelled proposals.

    ``labels`` has ``id`` and ``label`` (0 or 1; other values and nulls are left out).  At most about
    ``sample`` labelled rows, taken by a hash of their id, are learnt from; texts are never cut.
    Returns ``id`` and ``score``, one row per input row.  Without usable labels every score is 0.5.
    Null and empty texts are scored by the statistics of an empty text.  No text is shuffled.
    """
    model = fit_quality(proposals, labels, id, text, label, sample)
    rows = proposals.select(F.col(id), text_or_empty(text).alias("body"))
    scored = map_texts(rows, quality_scores(proposals.sparkSession, model), "stage_score double")
    return scored.withColumnRenamed("stage_score", "score")
