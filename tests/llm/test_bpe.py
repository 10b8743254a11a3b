"""Encoding and decoding against the tokenizers library on the whole text."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirework.llm import bpe

T = bpe.tokenizer(bpe.vocabulary())


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def direct(text):
    ids = T.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(T.decode(ids, skip_special_tokens=False))


def treed(text, leaf):
    parts = [(p, bpe.encode_piece(T, p)) for p in bpe.leaf_texts(text, leaf, bpe.special_texts(T))]
    while len(parts) > 1:
        out = []
        for (a, x), (b, y) in zip(parts[::2], parts[1::2]):
            out.append((a + b, bpe.join_tokens(T, a, x, b, [(i, s + len(a), e + len(a)) for i, s, e in y])))
        parts = out
    return [x[0] for x in parts[0][1]]


ALPHABET = st.sampled_from(list("abcdeTHing s's'll've\n.,!?0123#$é") + ["ß", "İ", "é", "́", "日本", "👍🏽", "ก็", "각", "가", "<|endoftext|>", "<|start", "oftext|>", "''", " "])


@settings(max_examples=600, deadline=None)
@given(st.lists(ALPHABET, max_size=160), st.integers(3, 30))
def test_tree_is_the_whole_encoding(parts, leaf):
    text = "".join(parts)
    assert treed(text, leaf) == T.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("make", [lambda r: "a" * 5000, lambda r: "".join(r.choice("thein") for _ in range(6000)), lambda r: "".join(r.choice("!?#") for _ in range(6000)),
                                  lambda r: "'" * 3000 + "s" * 3000, lambda r: "日" * 3000, lambda r: "".join(r.choice(["the", "ing", "er", "s", "'ve"]) for _ in range(3000))])
def test_long_unsplit_runs(make):
    text = make(random.Random(3))
    for leaf in (64, 700):
        assert treed(text, leaf) == T.encode(text, add_special_tokens=False).ids


def test_query_rows(frame):
    rnd = random.Random(7)
    long = "".join(rnd.choice(["the ", "ing", "er", " ", "é", "12", "<|endoftext|>"]) for _ in range(9000)) + "".join(rnd.choice("abcé!1") for _ in range(3000))
    odd = "a\x1cb\x85c\xa0d\u3000e \u0301f\tG\x0bh <|endoftext|>x <|ENDOFTEXT|> İΣ"
    rows = [(20, odd), (21, odd * 200)] + [(1, "Hello there, it's 1999!"), (2, None), (3, ""), (4, " \n"), (5, long), (6, long), (None, long[:5000]), (7, "x" * 4000), (7, "x" * 4000), (8, "<|startoftext|>a<|endoftext|>")]
    for path in (None, bpe.vocabulary()):
        got = sorted((tuple(r) for r in bpe.report(frame(rows), path, leaf=300).collect()), key=str)
        assert got == sorted(((i, *direct(t)) for i, t in rows), key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=60))
def test_pieces_are_the_whole_encoding(parts):
    text = "".join(parts)
    (n, ids, decoded), = zip(*(a.to_pylist() for a in bpe._from_pieces("digests", bpe.Pieces(T, bpe.special_texts(T), keep_ids=False).of([text]))))
    assert (n, ids, decoded) == direct(text)
    tokens, = bpe._from_pieces("tokens", bpe.Pieces(T, bpe.special_texts(T)).of([text]))
    assert tokens.to_pylist() == [T.encode(text, add_special_tokens=False).ids]


def test_columns_pass_through(spark, frame):
    docs = spark.createDataFrame([(1, "a b", 5, "z")], "doc_id long, text string, token_ids int, decoded string")
    out = bpe.encode(docs)
    assert out.columns == ["doc_id", "decoded", "token_ids"] and out.count() == 1
    assert bpe.encode(frame([])).count() == 0
