"""Both recursive queries of the codec against the library, and the cache of pieces."""

import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from docloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = np.random.default_rng(5)
    pick = lambda letters, n: "".join(np.array(list(letters))[rng.integers(0, len(letters), n)])
    out = ["x" * 3000, "ab" * 1500 + "a", "aab" * 900, "=" * 2500, " " * 1800, "的是不" * 500, "ing" * 700, "tthe" * 400]
    out += [pick("aab", 1500), pick("etaoin", 1800), pick("abcdefghijklmnopqrstuvwxyz", 1300), pick("äöüß", 900), pick("-=_*#", 1400)]
    return [*out, "", " and ".join(out[:3]), "plain words of a plain text, 12 345 and O'Neill's"]


@pytest.mark.parametrize("long", [3, bpe.LONG])
def test_pieces_of_any_length_equal_the_library(library, monkeypatch, long):
    monkeypatch.setattr(bpe, "LONG", long)
    codec = bpe.Codec(PATH, public_tokenizers.PATTERN)
    found = codec.encode(texts())
    assert [np.frombuffer(v, "<u4").tolist() for v in found] == [library.encode_ordinary(t) for t in texts()]
    assert codec.decode(found) == [t.encode() for t in texts()]


def test_pieces_met_before_are_kept_and_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 40)
    codec = bpe.Codec(PATH, public_tokenizers.PATTERN)
    for k in range(30):
        text = " ".join(f"zq{k}vx{n}jw" for n in range(10)) + " qzjxv again"
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)
        assert len(codec.encoded) + len(codec.before) <= 2 * (40 + 60)
