"""op3: tables of many pieces together, pairs judged by last merges, the trie, the two halves of the pieces' cache."""

import random

import public_tokenizers
import pytest
import tiktoken

from lexiform.llm import prefix_bpe

RANKS = prefix_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
#: "ab" has a higher rank than "abc", which it is part of: merges do not come in the order of ranks.
UNORDERED = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"ab": 257}


def codec():
    return prefix_bpe.Codec(RANKS, public_tokenizers.PATTERN)


def library(ranks=RANKS):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n=60):
    rng = random.Random(3)
    parts = ["th", "ing", "é", "ción", "Wh", "0", "17", "   ", "\n\n", "!!", "漢", "字", "🙂", "a" * 40, "x", "er", " ", " ", "'s", "\t"]
    return ["", " "] + ["".join(rng.choices(parts, k=rng.randrange(1, 120))) for _ in range(n)] + ["ab" * 5000, "é" * 700]


def test_pairs_are_judged_without_merging_their_bytes(monkeypatch):
    """CPU seconds of op3: every new pair of tokens was merged from its bytes."""
    own, other = codec(), library()

    def fail(*_):
        raise AssertionError("bytes of a pair are merged")

    own.bpe.encode(b"x")
    monkeypatch.setattr(own.bpe, "whole", lambda token: True)
    monkeypatch.setattr(own.bpe, "merged", fail)
    for text in texts(20):
        assert list(own.encode(text)) == other.encode_ordinary(text)


@pytest.mark.parametrize("chunk, together, cached, slots", [(1 << 21, 32, 300_000, 1 << 20), (1, 32, 8, 1 << 20), (300, 5, 50, 4), (300, 64, 2, 1)])
def test_texts_together_equal_the_library(monkeypatch, chunk, together, cached, slots):
    for name, value in {"CHUNK": chunk, "TOGETHER": together, "CACHED_PIECES": cached, "PAIR_SLOTS": slots}.items():
        monkeypatch.setattr(prefix_bpe, name, value)
    own, other, given = codec(), library(), texts()
    assert [list(x) for x in own.encode_all(given)] == [other.encode_ordinary(x) for x in given]
    assert len(own.pieces) + len(own.pieces.older) <= cached
    assert list(own.encode_all([])) == []


def test_pairs_by_last_merges_equal_merging():
    import numpy as np

    bpe, rng = codec().bpe, random.Random(5)
    ids = sorted(bpe.bytes_of)
    pairs = [(rng.choice(ids), rng.choice(ids[:400])) for _ in range(2000)] + [(rng.choice(ids[:300]), rng.choice(ids[:300])) for _ in range(4000)]
    pairs += [(bpe.ranks[t[:i]], bpe.ranks[t[i:]]) for t in rng.sample(sorted(RANKS), 2000) for i in range(1, len(t)) if t[:i] in RANKS and t[i:] in RANKS]
    want = [bpe.merged(bpe.bytes_of[a] + bpe.bytes_of[b]) == [a, b] for a, b in pairs]
    assert [bpe._apart(a, b) for a, b in pairs] == want and not all(want)
    left, right = np.array(pairs).T
    assert bpe._apart_many(left, right).tolist() == want
    assert bpe._compatible_many(left, right).tolist() == want == bpe._compatible_many(left, right).tolist()


def test_trie_holds_the_vocabulary_and_nothing_else():
    bpe, rng = codec().bpe, random.Random(7)

    def walk(text):
        node, at = 0, 0
        for byte in text:
            if node >= bpe._inner or bpe._owner[at := bpe._base[node] + byte] != node:
                return None
            node = bpe._next[at]
        return bpe._ends[node] if bpe._ends[node] >= 0 else None

    assert all(walk(token) == rank for token, rank in RANKS.items())
    others = [rng.choice(sorted(RANKS)[:5000]) + bytes([rng.randrange(256)]) for _ in range(300)]
    assert [walk(x) for x in others] == [RANKS.get(x) for x in others]


def test_vocabulary_out_of_order_is_merged():
    own = prefix_bpe.Codec(UNORDERED, public_tokenizers.PATTERN)
    assert own.bpe._splits is None
    given = ["abc", "abab", "cabcab", "bca", "x abcc"]
    assert [list(x) for x in own.encode_all(given)] == [library(UNORDERED).encode_ordinary(x) for x in given]


def test_a_byte_without_a_token_is_an_error():
    bpe = prefix_bpe.PrefixBpe({b"a": 0, b"b": 1, b"ab": 2})
    assert bpe.encode(b"aab") == [0, 2] and bpe.encode_many([b"aab", b""])[1] == b""
    for piece in (b"ac", b"ca", b"c"):
        with pytest.raises(ValueError):
            bpe.encode(piece)
        with pytest.raises(ValueError):
            bpe.encode_many([piece])
