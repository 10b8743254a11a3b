"""Byte-level encoding against the tiktoken library and a plain merge loop."""

import hashlib
import random
import struct

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quirework.llm import prefixes

V = prefixes.Vocabulary(prefixes.ranks_file())
LIBRARY = tiktoken.Encoding("own", pat_str=prefixes.pattern(), mergeable_ranks=V.ranks, special_tokens={})
E = prefixes.Remembered(V, prefixes.pattern())
ALPHABET = st.sampled_from(list("abcdeTHing s's'll've\n\t.,!?0123#$é") + ["ß", "İ", "́", "日本", "👍🏽", "ก็", "각", "<|endoftext|>", "''", "  ", "\x1c", "\x85", "　", " ", "the", " ing", "ation"])


def direct(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(LIBRARY.decode_bytes(ids)).hexdigest()


def merged(data, ranks):
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[x] for x in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@settings(max_examples=500, deadline=None)
@given(st.lists(ALPHABET, max_size=120))
def test_whole_texts(parts):
    text = "".join(parts)
    assert prefixes.ids_of(text, E).tolist() == LIBRARY.encode_ordinary(text)


def test_every_code_point():
    for lo in range(0, 0x30000, 512):
        text = "".join(f"ab{c}ab {c} {c}1{c}{c} .{c}\n{c}" for c in map(chr, range(lo, lo + 512)) if not 0xD800 <= ord(c) < 0xE000)
        assert b"".join(x[1] for x in E.encoded(text)) == text.encode()
        if lo < 0x3000:
            assert prefixes.ids_of(text, E).tolist() == LIBRARY.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"th", b"e", b"in", b"g", b"\xc3\xa9", b"\xe6", b"\x00", b"ss", b"ation"]), max_size=40))
def test_every_prefix(parts):
    data = b"".join(parts)
    table = prefixes.Prefixes(V, data[: len(data) // 2])
    table.append(data[len(data) // 2 :])
    for i in range(len(data) + 1):
        assert table.tokens(i) == merged(data[:i], V.ranks)


def test_edits_work_out_little_anew():
    rnd = random.Random(4)
    data = bytearray("".join(rnd.choice(["the", "ing", "er", "s", "qu", "ß"]) for _ in range(6000)).encode())
    table = prefixes.Prefixes(V, bytes(data))
    for _ in range(60):
        start = rnd.randrange(len(data))
        stop = min(len(data), start + rnd.choice([0, 0, 1, 5, 300]))
        new = "".join(rnd.choice(["in", "g", "x", "é", "st"]) for _ in range(rnd.choice([0, 1, 3, 200]))).encode()
        anew = table.edit(start, stop, new)
        data[start:stop] = new
        assert table.data == data and anew <= len(new) + 12 * V.longest
        assert table.last == prefixes.Prefixes(V, bytes(data)).last
    table.edit(0, len(data), b"")
    assert table.tokens() == [] and len(table.last) == 1


@pytest.mark.parametrize("make", [lambda r: "a" * 5000, lambda r: "".join(r.choice("thein") for _ in range(6000)), lambda r: "!?#" * 3000, lambda r: " " * 4000 + "x", lambda r: "日" * 3000, lambda r: "0123456789" * 500])
def test_long_unsplit_runs(make):
    text = make(random.Random(3))
    assert prefixes.ids_of(text, E).tolist() == LIBRARY.encode_ordinary(text)


def test_small_memory_and_slices(monkeypatch):
    for name, n in (("SLICE", 50), ("REMEMBERED", 3), ("PAIRS", 5), ("SHORT", 6)):
        monkeypatch.setattr(prefixes, name, n)
    rnd, e = random.Random(5), prefixes.Remembered(V, prefixes.pattern())
    text = "".join(rnd.choice(["the ", "ing", "er\n", " ", "  ", "é", "12", "　", "'s", "unsplit" * 20]) for _ in range(2000))
    assert prefixes.ids_of(text, e).tolist() == LIBRARY.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=60), st.lists(ALPHABET, max_size=10), st.lists(ALPHABET, max_size=60), st.lists(ALPHABET, max_size=10))
def test_revised(a, b, c, d):
    old, new = "".join(a + b + c), "".join(a + d + c)
    got, _ = prefixes.revised(E, old, prefixes.ids_of(old, E), new)
    assert got.tolist() == LIBRARY.encode_ordinary(new)


def test_revising_a_long_text_encodes_little():
    text = "".join(random.Random(1).choice(["the ", "sing ", "er, ", "12 "]) for _ in range(50_000))
    ids = prefixes.ids_of(text, E)
    for new in (text + "more", "x" + text, text[:70_000] + "zz " + text[70_000:], text[:90_000] + text[90_100:], text):
        got, read = prefixes.revised(E, text, ids, new)
        assert read < 60 and got.tolist() == LIBRARY.encode_ordinary(new)


def test_the_other_rank_file():
    import public_tokenizers

    v = prefixes.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("other", pat_str=prefixes.pattern(), mergeable_ranks=v.ranks, special_tokens={})
    text = "It's the 1999 edition — naïve, überall 日本\n\n  end" * 3 + "x" * 700
    assert prefixes.ids_of(text, prefixes.Remembered(v, prefixes.pattern())).tolist() == own.encode_ordinary(text)


def test_query_rows(frame):
    rnd = random.Random(7)
    long = "".join(rnd.choice(["the ", "ing", "er", " ", "é", "12", "<|endoftext|>"]) for _ in range(60_000))
    rows = [(1, "Hello there, it's 1999!"), (2, None), (3, ""), (4, " \n"), (5, long), (5, long), (None, "x" * 4000), (7, "a\x1cb\x85c\xa0d　e")]
    assert sorted((tuple(r) for r in prefixes.report(frame(rows)).collect()), key=str) == sorted(((i, *direct(t)) for i, t in rows), key=str)
    assert prefixes.report(frame([])).count() == 0


def test_columns_round_trip_and_revision(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "z"), (2, None, 6, "y")], "doc_id long, text string, token_ids int, decoded string")
    out = prefixes.encode(docs)
    assert out.columns == ["doc_id", "text", "decoded", "token_ids"]
    back = prefixes.decode(out)
    assert back.columns == ["doc_id", "text", "token_ids", "decoded"]
    assert sorted((r["doc_id"], bytes(r["decoded"])) for r in back.collect()) == [(1, b"a b"), (2, b"")]
    from pyspark.sql import functions as F
    new = prefixes.revise(out.withColumn("new_text", F.concat(F.coalesce("text", F.lit("")), F.lit("c d"))))
    assert sorted((r["doc_id"], r["text"], r["token_ids"]) for r in new.collect()) == [(1, "a bc d", LIBRARY.encode_ordinary("a bc d")), (2, "c d", LIBRARY.encode_ordinary("c d"))]
