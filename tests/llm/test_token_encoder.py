import random

import pytest
from tokenizers import Tokenizer

from duewise.llm import token_files


@pytest.fixture(scope="module")
def both():
    definition = token_files.tokenizer_definition()
    return token_files.WordEncoder(definition), Tokenizer.from_str(definition)


def same(both, text):
    own, library = both
    assert own.ids(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_capitals_beside_a_special_opening(both):
    for text in ("Hello World <| x", "HELLO <|endoftext|>World", "<|ENDOFTEXT|> A", "A<|B Hello", "don't DON'T It'S <|"):
        same(both, text)


def test_letters_that_normalising_splits(both):
    for text in ("İstanbul", "aİ.", "Σίσυφος ΣΣ", "क़लम", "שּׁלום", "été!"):
        same(both, text)
    for lo in range(0x80, 0x3000, 16):
        same(both, " ".join(f"Q{chr(c)}z! {chr(c)}cd." for c in range(lo, lo + 16)))


def test_mixed_texts(both):
    rng = random.Random(1)
    pool = [chr(c) for c in range(33, 0x600)] + list(" \n\t") * 100 + ["<|"] * 40 + ["<|endoftext|>"] * 20 + list("ABCabc'sdİ") * 20
    for _ in range(2000):
        same(both, "".join(rng.choice(pool) for _ in range(rng.randrange(1, 25))))


def test_a_full_cache_is_looked_through_once_more(both, monkeypatch):
    made, part = [], token_files.WordEncoder._part
    monkeypatch.setattr(token_files.WordEncoder, "_part", lambda self, x: made.append(x) or part(self, x))
    monkeypatch.setattr(token_files.WordEncoder, "KEEP", 20)
    encoder = token_files.WordEncoder(token_files.tokenizer_definition())
    text = " ".join(f"w{chr(97 + i)}x" for i in range(25))
    want = both[1].encode(text, add_special_tokens=False).ids
    for _ in range(4):
        assert encoder.ids(text.encode()).tolist() == want
    assert len(made) == 25
    assert len(encoder.parts) + len(encoder.parts.before) <= 50


def test_latin_letters_and_signs(both):
    for text in ("ÉPÉE, déjà-vu, «Ça», ÿ! ß× a÷b µm ªº ÀÉ;", "\u212a\u212b e\u0301t\u00e9. \u1e9eA", "i\u0307 é\u0301 d'été l\u2019été café<|x", "w1.2w, a-b (c) 'tis ''t", "<a|b> é<|endoftext|>é"):
        same(both, text)
        same(both, text.lower())
