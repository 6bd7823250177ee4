"""Token ids put together from words, against the tokenizer on the whole text."""

import numpy as np
import pytest

pytest.importorskip("nounspan.llm")

from nounspan.llm import packing  # noqa: E402
from nounspan.llm.queries import default_vocabulary  # noqa: E402


def both(words, text):
    got = np.frombuffer(words.of(text), "<u4").tolist()
    return got, words.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_word_is_tokenised_once_whatever_its_case_and_punctuation():
    words = packing.WordIds(default_vocabulary())
    calls = []
    model = words.model

    class Counted:
        def tokenize(self, word):
            calls.append(word)
            return model.tokenize(word)

    words.model = Counted()
    got, whole = both(words, "Straße straße, STRAßE. (Straße) \"straße\"\n“Straße”—straße's straße;")
    assert got == whole
    assert calls.count("straÃŁe") == 1 and len(calls) == len(set(calls)) == len(words)
    assert not [w for w in words if "straße" in w and w != "straße"]


def test_every_character_around_the_bounds_of_plain_text():
    words = packing.WordIds(default_vocabulary())
    assert words.cuts
    for c in (*range(0x260), *range(0x300, 0x310), *range(0x1FF0, 0x2070), 0x3000, 0x4E00, 0x1F600):
        c = chr(c)
        got, whole = both(words, f"a{c}b {c} {c}{c}1{c}'s X{c}\n'{c}S")
        assert got == whole, c
    for text in ("a<|endoftext|>b, c", "A<|startoftext|>", "x <| y", "<|ENDoftext|>", "İx, Word, word 日本 Word"):
        got, whole = both(words, text)
        assert got == whole, text


def test_a_vocabulary_that_cuts_differently(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    letters = sorted(packing.byte_letters().values())
    merges = [("n", "'"), ("n'", "t"), ("1", "2")]
    vocab = {t: i for i, t in enumerate([*letters, *(a + b for a, b in merges)])}
    other = Tokenizer(models.BPE(vocab=vocab, merges=merges))
    other.normalizer = normalizers.Lowercase()
    other.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    path = str(tmp_path / "other.json")
    other.save(path)
    words = packing.WordIds(path)
    for text in ("Don't, 12 won't\ndon't É", "", "word Word"):
        got, whole = both(words, text)
        assert got == whole, text
