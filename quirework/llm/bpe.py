"""BPE encoding and decoding with a given tokenizer file; long unsplit texts by tree concatenation.

The default vocabulary drops white space before it merges anything, so what stands between white space is encoded on
its own, and a worker remembers such pieces. A text with a piece of more than ``LEAF`` characters
(for a tokenizer that keeps white space: every longer text) is halved down to leaves, which are spread over the cluster
and encoded in parallel; then neighbours are joined level by level. At a join the text around the cut is encoded again,
in a window that doubles until its tokens agree with the tokens of both sides; what lies between the two places of
agreement comes from the window. Two neighbouring tokens that stand side by side in a valid encoding stand side by
side in every one, so the joined list is the encoding of the whole; if no window agrees, the last one is the whole
text of both sides. Cuts keep out of special tokens and of composed characters.

Null is encoded as the empty text, which has no token and decodes to the empty text. Special tokens written in a text
become their ids, as the tokenizer file says. Equal long texts are encoded once. Rows without doc_id, repeated rows
and further columns pass through.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import sys
import types
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, narrow, row_slices

LEAF = 1 << 13
REMEMBERED = 120_000
WINDOW = 8

def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held(what: str, path: str, make):
    """What a worker process keeps from task to task: made once per tokenizer file."""
    cache = sys.modules.setdefault("_quirework_llm_held", types.ModuleType("_quirework_llm_held")).__dict__
    if (what, path) not in cache:
        cache[what, path] = make()
    return cache[what, path]


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return held("tokenizer", path, lambda: Tokenizer.from_file(path))


def special_texts(t) -> list[str]:
    return [x.content for x in t.get_added_tokens_decoder().values()]


def safe_cut(text: str, at: int, special: list[str]) -> int:
    """The first place from ``at`` on that splits neither a special token nor a composed character."""
    while at < len(text):
        for s in special:
            i = text.find(s, max(at - len(s) + 1, 0), at + len(s) - 1)
            if 0 <= i < at:
                at = i + len(s)
                break
        else:
            c = text[at]
            if ord(c) < 0x300 or not (unicodedata.combining(c) or 0x1160 <= ord(c) <= 0x11FF or not unicodedata.is_normalized("NFC", c) or unicodedata.category(c)[0] == "M"):
                break
            at += 1
    return min(at, len(text))


def leaf_texts(text: str, leaf: int, special: list[str]) -> list[str]:
    """The text in 2**d pieces, some perhaps empty, none much longer than ``leaf``."""
    parts = [text]
    for _ in range(depth(len(text), leaf)):
        halves = []
        for p in parts:
            c = safe_cut(p, len(p) // 2, special)
            halves += [p[:c], p[c:]]
        parts = halves
    return parts


def depth(chars: int, leaf: int) -> int:
    return max(0, math.ceil(math.log2(chars / leaf))) if chars > leaf else 0


def encode_piece(t, text: str, shift: int = 0) -> list[tuple[int, int, int]]:
    e = t.encode(text, add_special_tokens=False)
    return [(i, a + shift, b + shift) for i, (a, b) in zip(e.ids, e.offsets)]


def _clean_places(tokens: list[tuple[int, int, int]]) -> dict[tuple[int, int, int], int]:
    """Tokens that start and end between characters, by (id, start, end)."""
    out = {}
    for i, x in enumerate(tokens):
        if (i == 0 or tokens[i - 1][2] <= x[1]) and (i + 1 == len(tokens) or x[2] <= tokens[i + 1][1]):
            out[x] = i
    return out


def join_tokens(t, left: str, lt: list[tuple[int, int, int]], right: str, rt: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Tokens of left + right, from the tokens of both; all offsets count from the start of left."""
    text = left + right
    n = WINDOW
    while True:
        whole_left, whole_right = n >= len(lt), n >= len(rt)
        lo = 0 if whole_left else lt[-n][1]
        hi = len(text) if whole_right else rt[n - 1][2]
        w = encode_piece(t, text[lo:hi], lo)
        if whole_left and whole_right:
            return w
        places = _clean_places(w)
        start = (0, 0) if whole_left else _agreement(w, places, lt, range(max(len(lt) - n, 0), len(lt) - 1))
        end = (len(w), len(rt)) if whole_right else _agreement(w, places, rt, range(n - 2, -1, -1))
        if start is not None and end is not None and start[0] <= end[0]:
            return lt[: start[1]] + w[start[0] : end[0]] + rt[end[1] :]
        n *= 2


def _agreement(w, places, side, order):
    """(index in the window, index in the side) of two neighbouring tokens that both lists have."""
    own = _clean_places(side[min(order) : max(order) + 3]) if len(order) else {}
    for i in order:
        if side[i] in places and side[i] in own and i + 1 < len(side):
            at = places[side[i]]
            if at + 1 < len(w) and w[at + 1] == side[i + 1] and side[i + 1] in own:
                return at, i
    return None


KINDS = {
    "tokens": [("token_ids", "array<int>")],
    "both": [("token_ids", "array<int>"), ("decoded", "string")],
    "digests": [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")],
}


# Lower-case ASCII letters, then marks without an apostrophe: the tokenizer itself parts the two.
_WORD_AND_MARKS = re.compile(rb"([a-z]+)([!-&(-/:-@\[-`{-~]+)")
_PLAIN = re.compile(rb"[a-z]+|[!-&(-/:-@\[-`{-~]+")


class Pieces:
    """Encodings of what stands between white space: token ids or (only as many) the ids in decimal, and the decoded text.

    Two generations of at most ``REMEMBERED`` pieces; what is met again moves to the newer one.
    """

    def __init__(self, t, special: list[str], keep_ids: bool = True):
        self.t, self.keep_ids, self.new, self.old, self.blank = t, keep_ids, {}, {}, False
        self.special = [x.encode() for x in special]

    def _cut(self, text: str) -> list[bytes]:
        """At ASCII white space only. The tokenizer lower-cases; special tokens are read before that."""
        data = text.encode()
        if not any(x[:2] in data for x in self.special):
            data = data.lower()
        return data.split()

    def of(self, texts: list[str]) -> list[list[tuple]]:
        own = [self._cut(x) for x in texts]
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        missing, split = set(), {}
        for p in set(chain.from_iterable(own)).difference(self.new):
            if p in self.old:
                self.new[p] = self.old[p]
            elif m := _WORD_AND_MARKS.fullmatch(p):
                split[p] = m.groups()
                missing.update(x for x in m.groups() if x not in self.new)
            else:
                missing.add(p)
        # One word of the tokenizer's own goes to its model at once; everything else through the whole tokenizer.
        plain = [p for p in missing if _PLAIN.fullmatch(p)]
        other = list(missing.difference(plain))
        missing = plain + other
        model = self.t.model
        ids = [[x.id for x in model.tokenize(p.decode())] for p in plain]
        ids += [e.ids for e in self.t.encode_batch_fast([p.decode() for p in other], add_special_tokens=False)]
        decoded = self.t.decode_batch(ids, skip_special_tokens=False)
        for p, i, d in zip(missing, ids, decoded):
            self.new[p] = (i, "", d) if self.keep_ids else (range(len(i)), " ".join(map(str, i)), d)
        for p, (a, b) in split.items():
            a, b = self.new[a], self.new[b]
            self.new[p] = (a[0] + b[0] if self.keep_ids else range(len(a[0]) + len(b[0])), f"{a[1]} {b[1]}", f"{a[2]} {b[2]}")
        self.blank = self.blank or not all(ids)  # some Unicode white space standing alone has no token
        rows = [list(map(self.new.__getitem__, row)) for row in own]
        return [[x for x in row if x[0]] for row in rows] if self.blank else rows


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def _from_pieces(kind: str, rows: list[list[tuple]]) -> list[pa.Array]:
    """The columns of ``KINDS[kind]``. Without a decoder, decoding joins the tokens' texts by one space."""
    if kind == "digests":
        ids = [" ".join([x[1] for x in r]) for r in rows]
        return [pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64()), pa.array([_sha(x) for x in ids], pa.string()), pa.array([_sha(" ".join([x[2] for x in r])) for r in rows], pa.string())]
    ids = pa.array([list(chain.from_iterable(x[0] for x in r)) for r in rows], pa.list_(pa.int32()))
    return [ids] if kind == "tokens" else [ids, pa.array([" ".join([x[2] for x in r]) for r in rows], pa.string())]


def _finish(t, kind: str, ids: list[list[int]]) -> list[pa.Array]:
    """The columns of ``KINDS[kind]`` for some rows' token ids."""
    decoded = [t.decode(x, skip_special_tokens=False) for x in ids] if kind != "tokens" else []
    if kind == "digests":
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array([_sha(" ".join(map(str, x))) for x in ids], pa.string()), pa.array([_sha(x) for x in decoded], pa.string())]
    out = [pa.array(ids, pa.list_(pa.int32()))]
    return out if kind == "tokens" else [*out, pa.array(decoded, pa.string())]


def _schema(rest: DataFrame, kind: str) -> T.StructType:
    schema = T.StructType(list(rest.schema.fields))
    for name, type_ in KINDS[kind]:
        schema = schema.add(name, T.ArrayType(T.IntegerType()) if type_ == "array<int>" else type_)
    return schema


def encode(docs: DataFrame, path: str | None = None, leaf: int = LEAF, kind: str = "tokens") -> DataFrame:
    """The columns of ``docs`` but text, and the columns of ``KINDS[kind]`` (which replace any of their names).

    ``path`` is a tokenizer file; the default one is known to drop white space and to have no decoder.
    """
    apart = path is None
    path = path or vocabulary()
    names = [n for n, _ in KINDS[kind]]
    rest = [c for c in docs.columns if c not in ("text", *names)]
    schema = _schema(docs.select(*rest), kind)
    is_long = F.length("text") > leaf
    if apart:
        is_long = is_long & F.col("text").rlike(f"[^ \\t\\n\\x0B\\f\\r]{{{leaf + 1}}}")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        pieces = held(f"pieces for {kind}", path, lambda: Pieces(t, special_texts(t), kind != "digests"))
        for batch in batches:
            for lo, hi in row_slices(batch.column("text"), 1 << 18):
                own = batch.slice(lo, hi - lo)
                texts = [x or "" for x in own.column("text").to_pylist()]
                if apart:
                    out = _from_pieces(kind, pieces.of(texts))
                else:
                    out = _finish(t, kind, [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)])
                yield pa.RecordBatch.from_arrays([own.column(c) for c in rest] + out, names=[*rest, *names])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([own.column(c) for c in rest] + _finish(t, kind, own.column("_ids").to_pylist()), names=[*rest, *names])

    short = narrow(docs).where(F.coalesce(~is_long, F.lit(True))).select(*rest, "text").mapInArrow(whole, schema)
    long = docs.where(is_long).withColumns({"_a": F.xxhash64("text"), "_b": F.xxhash64(F.lit(5), "text")})
    most = long.agg(F.max(F.length("text"))).first()[0]
    if most is None:
        return short
    done = _tree(long.select("_a", "_b", "text"), path, leaf, depth(most, leaf))
    return short.unionByName(long.drop("text").join(done, ["_a", "_b"]).select(*rest, "_ids").mapInArrow(joined, schema))


def _tree(texts: DataFrame, path: str, leaf: int, levels: int) -> DataFrame:
    """_a, _b and the token ids of each distinct text."""
    kind = "_a long, _b long, deep int, node long, text string, tokens array<int>"
    names = ["_a", "_b", "deep", "node", "text", "tokens"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32())]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(6)], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = special_texts(tokenizer(path))
        for batch in batches:
            for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("_a", "_b", "text"))):
                yield batch_of([(a, b, depth(len(text), leaf), i, p, []) for i, p in enumerate(leaf_texts(text, leaf, special))])

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for r in batch.to_pylist():
                yield batch_of([(r["_a"], r["_b"], r["deep"], r["node"], r["text"], flat(encode_piece(t, r["text"])))])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for r in batch.to_pylist():
                two = sorted(r["two"], key=lambda x: x["node"])
                left, right = two
                n = len(left["text"])
                rt = [(i, a + n, b + n) for i, a, b in unflat(right["tokens"])]
                got = join_tokens(t, left["text"], unflat(left["tokens"]), right["text"], rt)
                yield batch_of([(r["_a"], r["_b"], r["deep"] - 1, r["node"], left["text"] + right["text"], flat(got))])

    def flat(tokens):
        return [v for x in tokens for v in x]

    def unflat(values):
        return list(zip(values[0::3], values[1::3], values[2::3]))

    # A leaf goes to a task by text and number: no task has all leaves of a text. Equal texts meet here and go on once.
    nodes = texts.mapInArrow(cut, kind).dropDuplicates(["_a", "_b", "node"]).mapInArrow(encode_leaves, kind)
    for level in range(levels, 0, -1):
        pairs = nodes.where(F.col("deep") == level).groupBy("_a", "_b", "deep", F.shiftright("node", 1).alias("node")).agg(F.collect_list(F.struct("node", "text", "tokens")).alias("two"))
        nodes = cut_lineage(nodes.where(F.col("deep") < level).unionByName(pairs.mapInArrow(join, kind)))
    ids = F.transform(F.sequence(F.lit(0), F.floor(F.size("tokens") / 3).cast("int") - 1), lambda i: F.get("tokens", i * 3))
    return nodes.select("_a", "_b", F.when(F.size("tokens") > 0, ids).otherwise(F.array().cast("array<int>")).alias("_ids"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of ``encoded`` and ``decoded``, the text of token_ids, special tokens included."""
    path = path or vocabulary()
    rest = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            got = [t.decode(x or [], skip_special_tokens=False) for x in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(got, pa.string())], names=[*rest, "decoded"])

    return narrow(encoded.select(*rest)).mapInArrow(run, encoded.select(*rest).schema.add("decoded", "string"))


def report(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """One row per document: the number of tokens and the digests of ids and decoded text."""
    return encode(docs.select("doc_id", "text"), path, leaf, "digests")
