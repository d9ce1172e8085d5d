import random
import re

import numpy as np
import pytest
import xxhash

from llm_cases import CLASHING, awkward, proposals
from panelspark.llm.hamming import agreeing, close_pairs
from panelspark.llm.simhash import link_similar_proposals, ring_masks


def fingerprint(text):
    """Brute force after the definition."""
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0D]+", words) if w]
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows):
    prints = [(i, fingerprint(t)) for i, t in rows]
    least = {}
    for i, f in prints:
        if i is not None:
            least[f] = min(least.get(f, i), i)
    root = {f: i for f, i in least.items()}
    changed = True
    while changed:
        changed = False
        for f in root:
            for g in root:
                if (f ^ g).bit_count() <= 2:
                    if root[g] < root[f]:
                        root[f] = root[g]
                        changed = True
    return sorted(((i, f, root.get(f)) for i, f in prints), key=repr)


def test_awkward_texts_against_brute_force(spark):
    rows = awkward()
    got = link_similar_proposals(proposals(spark, rows, CLASHING)).collect()
    assert sorted(((r.ID_PROPOSTA, r.fingerprint % 2 ** 64, r.component) for r in got), key=repr) == groups(rows)


def test_empty_table(spark):
    assert link_similar_proposals(proposals(spark, [])).collect() == []


@pytest.mark.parametrize("bucket", [1, 4, 1000])
def test_every_close_pair_is_found_once(spark, bucket):
    rng = random.Random(11)
    prints = set()
    while len(prints) < 400:
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(60):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    number = {s: i for i, s in enumerate(signed)}
    for distance, masks, parts in ((2, ring_masks(), 4), (3, agreeing(0, 5, 3), 6)):
        want = {(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= distance}
        got = [tuple(sorted((number[r.a], number[r.b]), reverse=True)) for r in close_pairs(df, distance, masks, parts, 3, bucket).collect()]
        assert len(got) == len(set(got)) and set(got) == want
