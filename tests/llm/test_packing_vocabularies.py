"""Ids of every vocabulary file are those of its own tokenizer."""

import random

import pytest
from tokenizers import Tokenizer

from ashlar.llm.packing import WordIds
from ashlar.llm.queries import tokenizer_path

PARTS = ["word", " Word", "it's", "WE'LL", "42", "é", "Straße", "İ", "中文", "💥", "\n\n", "\t", "  ", "...", "<|endoftext|>", "<|", "́", " ", "ﬁ"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_tokenizers(name):
    whole = Tokenizer.from_file(tokenizer_path(name))
    with open(tokenizer_path(name), encoding="utf-8") as f:
        ids = WordIds(f.read())
    assert ids.by_words == name.startswith("word")
    rnd = random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 12)))
        want = whole.encode(text, add_special_tokens=False).ids
        assert memoryview(ids.encode(text)).cast("I").tolist() == want, text
