import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from marquee.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_random_texts(vocabulary, library):
    rng, encoder = random.Random(1), bpe.Encoder(vocabulary)
    for _ in range(1500):
        text = "".join(rng.choice("ab \n\t\x1c\x85　'sé漢😀1२.!?\r") for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "é" * 700, " " * 3000, "!?" * 999, "xyzw" * 100 + "q"])
def test_long_pieces(vocabulary, library, text):
    assert np.frombuffer(bpe.Encoder(vocabulary).encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_long_and_matrix_merges_agree(vocabulary):
    rng = random.Random(2)
    pieces = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 60))).encode() for _ in range(300)]
    assert vocabulary.merge_rows(pieces) == [vocabulary.merge_long(p) for p in pieces]


def test_memory_and_lazy_split_change_nothing(vocabulary, monkeypatch):
    text = "Some words, some more words; 123 and ünïcödé " * 50
    want = bpe.Encoder(vocabulary).encode(text)
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    assert bpe.Encoder(vocabulary).encode(text) == want


def test_rows(spark, docs, edge_pairs, library):
    got = sorted((tuple(r) for r in bpe.encode(spark, docs(edge_pairs, more=("ids", "n_tokens"))).collect()), key=str)
    want = []
    for i, t in edge_pairs:
        ids, raw = library.encode_ordinary(t or ""), (t or "").encode()
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest(), ids))
    assert got == sorted(want, key=str)


def test_decode_gives_the_bytes_back(spark, docs, edge_pairs):
    made = bpe.decode(spark, bpe.encode(spark, docs(edge_pairs)))
    assert sorted(bytes(r.decoded) for r in made.collect()) == sorted((t or "").encode() for _, t in edge_pairs)


def test_empty_table(spark, docs):
    assert bpe.encode(spark, docs([(1, "a")]).where("doc_id = 2")).collect() == []
