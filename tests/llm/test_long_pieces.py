"""Token counts of texts without piece bounds: state maps of chunks inside a piece, composed."""

import random

import pytest

from locusflow.llm import tokens


@pytest.fixture(scope="module")
def both():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return tokens.load(f.read()), Tokenizer.from_file(path)


def cases():
    r = random.Random(3)
    letters = lambda some, n: "".join(r.choice(some) for _ in range(n))
    return ["a" * 5003, "ab" * 4001, "the" * 3001, " " * 7001, "é" * 2999, "=-" * 3000, "0" * 4001, "\n" * 5001, letters("abcdefghij", 20_001), letters("etaoin", 9_999), "x " * 3000 + "hello" * 900 + " end " + "zq" * 800, "A" * 999 + "b" * 999 + "c" * 3000]


def test_counts_equal_the_library(both):
    own, library = both
    texts = cases()
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert own.count([t.encode() for t in texts]).tolist() == want
    assert [own.count([t.encode()])[0] for t in texts] == want


@pytest.mark.parametrize("rounds", [0, 1])
def test_true_states_are_followed_where_maps_lack_them(both, monkeypatch, rounds):
    own, library = both
    monkeypatch.setattr(tokens, "ROUNDS", rounds)
    monkeypatch.setattr(tokens, "AHEAD", 1)
    for t in cases():
        assert own.count([t.encode()])[0] == len(library.encode(t, add_special_tokens=False).ids)
