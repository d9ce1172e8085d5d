"""Token counts of proposal texts by byte-pair merging of words, without producing identifiers."""

from __future__ import annotations

import heapq
import json
import unicodedata

import regex
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import map_texts, text_or_empty

CACHE = 1 << 17
LIMIT = 2048

# The word pattern and the white space of the vocabulary file's own pre-tokeniser.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"


def _visible_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def load_merges(path: str) -> dict:
    """What counting needs of a tokenizers .json file with end-of-word BPE: bounded by its vocabulary."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    vocabulary, end = model["vocab"], model["end_of_word_suffix"] or ""
    inner, last = [0] * 256, [0] * 256
    for char, byte in _visible_bytes().items():
        inner[byte], last[byte] = vocabulary[char], vocabulary[char + end]
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges[vocabulary[a] << 32 | vocabulary[b]] = (rank, vocabulary[a + b])
    return {"inner": inner, "last": last, "merges": merges,
            "special": [t["content"] for t in spec["added_tokens"]]}


def count_symbols(word: bytes, table: dict) -> int:
    """Initial symbols minus merges, popping the lowest-ranked (then leftmost) adjacent pair."""
    n, merges = len(word), table["merges"]
    if n < 2:
        return n
    symbols = [table["inner"][b] for b in word]
    symbols[-1] = table["last"][word[-1]]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(found[0], i, key) for i in range(n - 1)
            if (found := merges.get(key := symbols[i] << 32 | symbols[i + 1]))]
    heapq.heapify(heap)
    count = n
    while heap:
        _, i, key = heapq.heappop(heap)
        j = after[i]
        # Stale when either symbol has changed or gone since the pair was queued.
        if symbols[i] < 0 or j >= n or symbols[i] << 32 | symbols[j] != key:
            continue
        symbols[i], symbols[j] = merges[key][1], -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        count -= 1
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n:
                pair = symbols[left] << 32 | symbols[right]
                if (found := merges.get(pair)):
                    heapq.heappush(heap, (found[0], left, pair))
    return count


class Counts(dict):
    """Counts of words already seen, emptied when full so that memory stays bounded."""

    def __init__(self, table: dict):
        super().__init__()
        self.table = table

    def __missing__(self, word: str) -> int:
        count = count_symbols(word.encode("utf-8"), self.table)
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = count
        return count


def count_proposal_tokens(proposals: DataFrame, vocabulary: str, id: str = "ID_PROPOSTA",
                          text: str = "OBJETO_PROPOSTA", limit: int = LIMIT) -> DataFrame:
    """Size of every proposal's whole object in the tokens of a public vocabulary file.

    Returns ``id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens),
    one row per input row and without a shuffle.  ``vocabulary`` is the path of a tokenizers .json
    file with end-of-word byte-pair merges; the driver reads it and broadcasts its merges (bounded
    by the vocabulary).  Texts are composed (NFC), lower-cased and cut into words; white space is
    dropped; the file's special strings count one token each.  Null and empty texts have no tokens.
    """
    table = proposals.sparkSession.sparkContext.broadcast(load_merges(vocabulary))

    def count(texts: list[bytes | None]) -> dict:
        words, special = regex.compile(PATTERN), "|".join(map(regex.escape, table.value["special"]))
        known = Counts(table.value)
        split = regex.compile(special).split if special else lambda text: [text]
        tokens = []
        for raw in texts:
            pieces = split(raw.decode("utf-8", "replace"))
            total = len(pieces) - 1
            for piece in pieces:
                # Lower-casing is by character: no final sigma.
                piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
                total += sum(map(known.__getitem__, words.findall(piece)))
            tokens.append(total)
        return {"n_bytes": [len(raw) for raw in texts], "n_tokens": tokens}

    rows = proposals.select(F.col(id), text_or_empty(text).alias("body"))
    return (map_texts(rows, count, "n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
