"""Byte-level BPE by prefix dynamic programming.

The encoding of a text's first i bytes is the encoding of its first j bytes and one last token more, for exactly one
token that ends at i: the one that stands unmerged behind the last token of those j bytes. ``Prefixes`` keeps that token
for every i, found among the vocabulary's tokens that end there (one automaton finds them all) by asking whether the pair
would stay apart, which the merges that made the two tokens decide alone. So an append goes on where the table ends, an
edit recomputes from its place until as many entries as the longest token has bytes agree with the old ones, and the
encoding of any prefix is read backwards from the table.

Merges happen inside matches of the pattern only. Texts are cut before white space that follows something else, where a
match always ends, so the matches between two such cuts depend on nothing outside; each distinct stretch goes through
the table once per worker process and is remembered there (bounded). A very long text is encoded stretch by stretch; one
match of many MB is one table of four bytes per byte, in one task. A match that is a token as a whole is that token, as
the rank file's library has it, also if no merges lead to it.

Null is encoded as the empty text, which has no token and decodes to nothing. Text that looks like a special token is
ordinary text. Repeated rows, rows without doc_id and further columns pass through; the result's own column names replace
columns of the same name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import held
from .common import narrow, row_slices

REMEMBERED = 600_000
REMEMBERED_CHARS = 64
PAIRS = 300_000
SHORT = 256  # bytes of a match
SLICE = 1 << 20
NONE = -1

# White space as the pattern means it; Python's own class has four separators more.
_STRETCH = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
_CUT = re.compile(r"[\S\x1c-\x1f](?=[^\S\x1c-\x1f])")


def ranks_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Vocabulary:
    """Tokens by rank, the merge that makes each, and an automaton over those that merges lead to."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.longest = max(map(len, self.tokens.values()))
        size = max(self.tokens) + 1
        self.left, self.right, self.size, self.pairs = [NONE] * size, [NONE] * size, size, {}
        self.made = [NONE] * size  # when merges make the token: by rank; single bytes are there from the start
        self.length = [0] * size
        for rank, token in sorted(self.tokens.items()):
            self.length[rank] = len(token)
            if len(token) > 1 and (cut := self._merge_of(token)):
                self.left[rank], self.right[rank] = cut
                self.pairs[cut[0] * size + cut[1]] = self.made[rank] = rank
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the rank file lacks single bytes")
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for rank, token in self.tokens.items():
            if len(token) == 1 or self.left[rank] != NONE:
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()

    def _merge_of(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one: they stay apart under the merges known so far, those before it."""
        for i in range(1, len(token)):
            a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
            if a is not None and b is not None and all(len(self.tokens[x]) == 1 or self.left[x] != NONE for x in (a, b)) and self.apart(a, b):
                return a, b
        return None

    def apart(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, encoded together, are a and b.

        Merges happen in order of rank, the leftmost first, so the token on either side of the cut is known at any time.
        Backwards from the end: if the two now at the cut would merge before what happens next, they don't stay apart.
        """
        left, right, made, pairs, size = self.left, self.right, self.made, self.pairs, self.size
        until = size
        while True:
            merged = pairs.get(a * size + b)
            if merged is not None and merged < until:
                return False
            x, y = made[a], made[b]
            if x > y:
                until, a = x, right[a]
            elif y != NONE:
                until, b = y + 1, left[b]
            else:
                return True


class Prefixes:
    """The last token of every byte prefix of one match of the pattern."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), array("i", [NONE])
        self.append(data)

    def append(self, data: bytes) -> None:
        for lo in range(0, len(data), SLICE):
            self._extend(data[lo : lo + SLICE])

    def _extend(self, data: bytes) -> None:
        v, last, old = self.vocabulary, self.last, len(self.data)
        before = min(old, v.longest - 1)
        self.data += data
        last.frombytes(array("i", [NONE]).tobytes() * len(data))
        base, length, apart = old - before + 1, v.length, v.apart
        for end, token in v.automaton.iter(self.data[old - before :].decode("latin-1")):
            end += base
            if end > old and last[end] == NONE:
                start = end - length[token]
                if not start or apart(last[start], token):
                    last[end] = token

    def tokens(self, size: int | None = None) -> list[int]:
        """The encoding of the first ``size`` bytes (all)."""
        at, out = len(self.data) if size is None else size, []
        while at:
            out.append(self.last[at])
            at -= self.vocabulary.length[out[-1]]
        return out[::-1]

    def edit(self, start: int, stop: int, data: bytes) -> int:
        """Puts ``data`` in place of bytes start to stop; returns how many entries were worked out anew."""
        tail, old = bytes(self.data[stop:]), self.last[stop:]
        del self.data[start:], self.last[start + 1 :]
        self.append(data)
        new, step, done = len(self.data), self.vocabulary.longest, 0
        # Entries behind the edit, old and new, from its end on; enough of them in a row that agree settle the rest.
        while done < len(tail):
            self.append(tail[done : done + step])
            done = min(done + step, len(tail))
            if done >= step and self.last[new + done - step + 1 :] == old[done - step + 1 : done + 1]:
                self.data += tail[done:]
                self.last += old[done + 1 :]
                break
        return len(data) + done


class Remembered(dict):
    """Stretch of text -> (its ids as little-endian 32-bit integers, the bytes they decode to)."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        super().__init__()
        self.vocabulary, self.matches = vocabulary, regex.compile(pattern).findall
        self.old, self.known = {}, {}

    def _match(self, text: str) -> list[int]:
        """The ids of one match of the pattern."""
        data, v = text.encode(), self.vocabulary
        whole = v.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) > SHORT:
            return Prefixes(v, data).tokens()
        # The table of a short match as a plain list that is not kept; answers about pairs are.
        last, known, length, size, apart = [NONE] * len(data), self.known, v.length, v.size, v.apart
        for end, token in v.automaton.iter(data.decode("latin-1")):
            if last[end] == NONE:
                start = end - length[token]
                if start < 0:
                    last[end] = token
                    continue
                pair = last[start] * size + token
                answer = known.get(pair)
                if answer is None:
                    if len(known) >= PAIRS:
                        known.clear()
                    answer = known[pair] = apart(last[start], token)
                if answer:
                    last[end] = token
        at, out = len(data) - 1, []
        while at >= 0:
            out.append(last[at])
            at -= length[last[at]]
        return out[::-1]

    def __missing__(self, stretch: str) -> tuple[bytes, bytes]:
        got = self.old.get(stretch)
        if got is None:
            ids = [i for text in self.matches(stretch) for i in self._match(text)]
            got = struct.pack(f"<{len(ids)}I", *ids), b"".join(map(self.vocabulary.tokens.__getitem__, ids))
        if len(stretch) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[stretch] = got
        return got

    def encoded(self, text: str) -> Iterator[tuple[bytes, bytes]]:
        """(ids, decoded bytes) of the text, a bounded number of characters (or one stretch) at a time."""
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + SLICE) if at + SLICE < len(text) else None
            end = cut.end() if cut else len(text)
            got = list(map(self.__getitem__, _STRETCH.findall(text, at, end)))
            yield b"".join([x[0] for x in got]), b"".join([x[1] for x in got])
            at = end


def encoder(path: str, pattern: str) -> Remembered:
    """What a worker process keeps from task to task."""
    return held(f"prefixes for {pattern}", path, lambda: Remembered(held("ranks", path, lambda: Vocabulary(path)), pattern))


def ids_of(text: str, e: Remembered) -> np.ndarray:
    return np.frombuffer(b"".join(x[0] for x in e.encoded(text)), "<u4").astype(np.int32)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def _mapped(docs: DataFrame, rest: list[str], fields: list[T.StructField], per_row) -> DataFrame:
    """``rest`` and what ``per_row(batch)`` returns as arrays, over slices of bounded bytes of text."""
    schema = T.StructType([docs.schema[c] for c in rest] + fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_slices(batch.column("text")):
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([own.column(c) for c in rest] + per_row(own), names=names)

    return narrow(docs).mapInArrow(run, schema)


IDS = T.StructField("token_ids", T.ArrayType(T.IntegerType()))


def encode(docs: DataFrame, path: str | None = None, pattern_text: str | None = None) -> DataFrame:
    """The columns of ``docs``, text among them, and token_ids."""
    path, pattern_text = path or ranks_file(), pattern_text or pattern()

    def per_row(batch: pa.RecordBatch) -> list[pa.Array]:
        e = encoder(path, pattern_text)
        return [_lists([ids_of(x or "", e) for x in batch.column("text").to_pylist()])]

    docs = docs.drop("token_ids")
    return _mapped(docs, docs.columns, [IDS], per_row)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of ``encoded`` and ``decoded``, the bytes of token_ids; null ids decode to nothing."""
    path = path or ranks_file()
    rest = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([encoded.schema[c] for c in rest] + [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = held("ranks", path, lambda: Vocabulary(path)).tokens
        for batch in batches:
            got = [b"".join(map(tokens.__getitem__, x or [])) for x in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(got, pa.binary())], names=[*rest, "decoded"])

    return narrow(encoded.select(*rest)).mapInArrow(run, schema)


def _shared(a: str, b: str) -> int:
    """How many characters two texts share at their start."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def revised(e: Remembered, old: str, ids: np.ndarray, new: str) -> tuple[np.ndarray, int]:
    """The ids of ``new`` from those of ``old``, and how many of its characters were encoded: what lies between the last
    cut before the first difference and the first cut behind the last one."""
    same = _shared(old, new)
    head = 0
    for m in _CUT.finditer(old, max(0, same - REMEMBERED_CHARS), same):
        head = m.end() if m.end() < same else head
    if not head and same > REMEMBERED_CHARS:
        for m in _CUT.finditer(old, 0, same):
            head = m.end() if m.end() < same else head
    behind = min(_shared(old[: head - 1 if head else None : -1], new[: head - 1 if head else None : -1]), len(old) - head, len(new) - head)
    m = _CUT.search(old, len(old) - behind) if behind else None
    tail = len(old) - m.end() if m else 0
    ends = np.cumsum([e.vocabulary.length[i] for i in ids.tolist()]) if len(ids) else np.zeros(0, int)
    first = int(np.searchsorted(ends, len(old[:head].encode()), "right")) if head else 0
    rest = int(np.searchsorted(ends, len(old[: len(old) - tail].encode()), "right")) if tail else len(ids)
    middle = new[head : len(new) - tail]
    return np.concatenate([ids[:first], ids_of(middle, e), ids[rest:]]).astype(np.int32), len(middle)


def revise(encoded: DataFrame, path: str | None = None, pattern_text: str | None = None) -> DataFrame:
    """Rows with text, token_ids and new_text become rows with text (the new one) and its token_ids; further columns stay.

    Only the stretches an edit or an append touches are encoded again. Null texts are empty.
    """
    path, pattern_text = path or ranks_file(), pattern_text or pattern()
    rest = [c for c in encoded.columns if c not in ("text", "token_ids", "new_text")]

    def per_row(batch: pa.RecordBatch) -> list[pa.Array]:
        e, ids, news = encoder(path, pattern_text), [], batch.column("new_text").to_pylist()
        for old, own, new in zip(batch.column("text").to_pylist(), batch.column("token_ids").to_pylist(), news):
            ids.append(revised(e, old or "", np.array(own or [], dtype=np.int32), new or "")[0])
        return [pa.array([x or "" for x in news], pa.string()), _lists(ids)]

    return _mapped(encoded, rest, [T.StructField("text", T.StringType()), IDS], per_row)


def report(docs: DataFrame, path: str | None = None, pattern_text: str | None = None) -> DataFrame:
    """doc_id, the number of tokens and the digests of ids and decoded bytes."""
    path, pattern_text = path or ranks_file(), pattern_text or pattern()

    def per_row(batch: pa.RecordBatch) -> list[pa.Array]:
        e, out = encoder(path, pattern_text), []
        for text in batch.column("text").to_pylist():
            n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
            for a, b in e.encoded(text or ""):
                n += len(a) // 4
                ids.update(a)
                decoded.update(b)
            out.append((n, ids.hexdigest(), decoded.hexdigest()))
        columns = list(zip(*out)) or [(), (), ()]
        return [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(docs.select("doc_id", "text"), ["doc_id"], fields, per_row)
