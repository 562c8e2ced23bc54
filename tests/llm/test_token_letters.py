from test_token_encoder import both, same  # noqa: F401


def test_parts_of_letters_are_kept_once(both):  # noqa: F811
    own, _ = both
    own.parts.clear()
    own.words.clear()
    for text in ("plain words of letters only", "Words and CAPITALS", "mixed, words. don't x1y", "<|startoftext|>plain a<|endoftext|>b Plain"):
        same(both, text)
    assert b"plain" in own.parts and not {"letters", "capitals", "only"} & set(own.words)
