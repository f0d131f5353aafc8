"""The packing's dictionary of words against its tokenizer."""

import random

import pytest

from hemline.llm import packing
from hemline.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def words():
    return packing._Words(tokenizer_path("word_bpe_49k.json"))


def test_short_way_gives_the_tokenizers_ids(words):
    assert words.short
    draw = random.Random(5)
    letters = "abzABZßÀÉéÿÞþØøµªºİſΣς1²½.,;:!?$%#*()&@+=_~^|/-'\"<>st́İ日😀×÷"
    made = {"".join(draw.choice(letters) for _ in range(draw.randint(1, 8))) for _ in range(20_000)}
    assert not [w for w in made if words[w] != words._encoded(w)]


def test_every_letter_and_sign_alone(words):
    for w in map(chr, range(33, 0x250)):
        assert words[w] == words._encoded(w)
        assert words["a" + w] == words._encoded("a" + w)


def test_tokenizer_of_another_kind_takes_the_long_way():
    other = packing._Words(tokenizer_path("byte_bpe_50k.json"))
    assert not other.short
    assert other["Word,"] == other._encoded("Word,")
