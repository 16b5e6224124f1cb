import random

import public_tokenizers
import pytest
import tiktoken

from foliant.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def texts():
    rng = random.Random(6)
    parts = ["'s", "'re", "'ll", "'", "'S", " ", "  ", "\n", "\r\n", "\t", " ", " ", "abc", "É", "ñ", "漢字", "1", "42", "²",
             "!!", "...", "_", "<|endoftext|>", "\0", "😀", "é", "the", "Theory", "\u001c"]
    out = ["", " ", "  ", "a", "'s", "''s", " 's", "\n's", "it's", "x'sable", "5're 'll''d", "a \n b", "a\n\n b  ", "\n", "\nfoo", " \nfoo"]
    out += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    out += ["a" * 3000, "ab" * 700 + "!" * 900, " " * 2000 + "x", "Donaudampfschiff" * 60]
    return out


def test_ids_equal_the_library(codec, library):
    some = texts()
    assert codec.encode(some) == [library.encode_ordinary(t) for t in some]
    assert [codec.decode(ids) for ids in codec.encode(some)] == [t.encode() for t in some]


def test_monoid_is_small():
    assert len(bpe._monoid()[1]) < 256


def test_cache_turns(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    some = [" ".join(f"word{i * 7 % 40}x" for i in range(200))]
    assert codec.encode(some) == [library.encode_ordinary(some[0])]


def test_a_merged_pair_is_looked_up_once(codec, library):
    asked = []

    class Ranks(dict):
        def get(self, key, *default):
            asked.append(key)
            return super().get(key, *default)

        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    held, codec.ranks = codec.ranks, Ranks(codec.ranks)
    try:
        assert list(codec._merged_short(b" loqueesga")) == library.encode_ordinary(" loqueesga")
    finally:
        codec.ranks = held
    assert asked and all(len(key) > 2 for key in asked)


def test_a_byte_without_a_rank_is_an_error():
    few = bpe.Codec(b"YQ== 0\nYmM= 1\nYWI= 2\n")  # a, bc, ab
    assert few.merged(b"abc") == (0, 1)
    with pytest.raises(KeyError):
        few.merged(b"ba")


def test_frames_round_trip(spark, library):
    some = texts()[:300] + [None]
    frame = spark.createDataFrame([(i % 50, t, "z") for i, t in enumerate(some)], "doc_id long, text string, ids string")
    found = bpe.decode(bpe.encode(frame, PATH), PATH).collect()
    assert sorted((r["id"], bytes(r["bytes"])) for r in found) == sorted((i % 50, (t or "").encode()) for i, t in enumerate(some))
    for r in found:
        raw = bytes(r["bytes"])
        assert r["ids"] == library.encode_ordinary(raw.decode())
        edges = r["starts"] + [len(raw)]
        assert [raw[a:b] for a, b in zip(edges, edges[1:])] == [library.decode_single_token_bytes(i) for i in r["ids"]]
    assert bpe.encode(frame.limit(0), PATH).count() == 0
