"""Pieces found by classes of bytes against the tokenizers library, and what is encoded once."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import wordpieces

PARTS = [*"abSTMDREVLrestvmdl''''\"-.,!012  \n\t\x0b", "'s", "'LL", "é", "É", "ß", "½", "²", "İ", "ı", "Ÿ", "ſ", "Ⱥ", "ɀ", "ǅ", "ª", "\x85", "\xa0", "\xad"]
PARTS += ["́", "Σ", "中", "\x00", "\x1c", "\x7f", "<|endoftext|>", "<|", "😀", "٣", " "]


def test_ids_of_odd_texts_are_the_library():
    rng = random.Random(3)
    library = Tokenizer.from_file(public_tokenizers.path(wordpieces.VOCABULARY))
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(3000)]
    texts += [f"{a}'{b}{c}" for a in ("", "a", "1", "'", " ", "é") for b in ("", "s", "t", "re", "r", "ve", "m", "ll", "l", "D", "ré") for c in ("", "a", "'s", "1", "é", "'")]
    encoder = wordpieces.WordEncoder(wordpieces.VOCABULARY)
    for text, ids in zip(texts, encoder.encode_many(texts), strict=True):
        assert list(ids) == library.encode(text, add_special_tokens=False).ids, text
        assert list(encoder.encode(text)) == list(ids)


def test_a_piece_is_kept_once_whatever_stands_beside_it(monkeypatch):
    encoder = wordpieces.WordEncoder(wordpieces.VOCABULARY)
    words = ["alpha", "beta", "Gamma", "DELTA"]
    texts = [f"{a}{x}{b}{y}{c}" for a in words for b in words for c in words for x in ".,;" for y in "-/:"]
    first = [list(x) for x in encoder.encode_many(texts)]
    assert len(encoder.known) == 4 + 6
    # The same in batches of one text, after the cache has been emptied again and again.
    monkeypatch.setattr(wordpieces, "AT_ONCE", 0)
    monkeypatch.setattr(wordpieces, "KEPT", 5)
    monkeypatch.setattr(wordpieces, "CORE", 2)
    assert [list(x) for x in encoder.encode_many(texts)] == first
