import random

import public_tokenizers
from tokenizers import Tokenizer

from llm_cases import CLASHING, awkward, proposals
from panelspark.llm.bpe import count_proposal_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_counts_equal_the_tokenizer(spark):
    rng = random.Random(1)
    signs = [*"abcXYZ'stre 12,.!?\n\t\x85\xa0 éÉßΣσςİıǅñ中文字한글😀👍🏽́̀①Ⅷﬁ‍\x1c\x1f​",
             "<|endoftext|>", "<|startoftext|>", "<|endof", "'ll", "'re", "ing", "tion", " the "]
    rows = awkward() + [(1000 + i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))) for i in range(2000)]
    library = Tokenizer.from_file(PATH)
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048)
                   for i, t in rows), key=repr)
    got = count_proposal_tokens(proposals(spark, rows, CLASHING), PATH).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_empty_table(spark):
    assert count_proposal_tokens(proposals(spark, []), PATH).collect() == []
