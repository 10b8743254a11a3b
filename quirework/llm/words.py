"""Words of whole texts as 64-bit hashes, a batch at a time, on the UTF-8 bytes.

A text is never cut: a row longer than the work size is hashed piece by piece between two separators.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20

_U = np.uint64


def _lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower()
SAME = np.arange(256, dtype=np.uint8)

# Everything but space and the control characters 9 to 13.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

# Digits, a-z and every byte of a character outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64)
_STEP = _rng.integers(1, 2**62, 2, dtype=np.uint64) * _U(2) + _U(1)
_GRAM = _rng.integers(1, 2**62, 2, dtype=np.uint64) * _U(2) + _U(1)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ _U((salt * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64)
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(step: np.uint64, n: int) -> np.ndarray:
    p = np.full(max(n, 1), step, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


@dataclass
class Words:
    """Words of the rows lo to hi: hashes of all words in order, how many each row has, and their byte ranges."""

    lo: int
    hi: int
    counts: np.ndarray
    hashes: np.ndarray
    second: np.ndarray | None
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts)

    @property
    def firsts(self) -> np.ndarray:
        """Index of each row's first word, and one past the last word."""
        return np.concatenate([[0], np.cumsum(self.counts)])


def _spans(data: np.ndarray, breaks: np.ndarray, fold: np.ndarray, inside: np.ndarray):
    m = inside[fold[data]]
    if not m.any():
        z = np.zeros(0, dtype=np.int64)
        return z, z
    prev = np.empty_like(m)
    prev[0] = False
    prev[1:] = m[:-1]
    prev[breaks[breaks < len(m)]] = False
    starts = np.flatnonzero(m & ~prev)
    nxt = np.empty_like(m)
    nxt[-1] = False
    nxt[:-1] = m[1:]
    b = breaks[(breaks > 0) & (breaks < len(m))] - 1
    nxt[b] = False
    return starts, np.flatnonzero(m & ~nxt) + 1


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray, which: int) -> np.ndarray:
    """Polynomial hashes of the byte ranges, scrambled; at most PIECE bytes are worked on at once."""
    out = np.empty(len(starts), dtype=np.uint64)
    lens = ends - starts
    cum = np.concatenate([[0], np.cumsum(lens)])
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(cum, cum[lo] + PIECE, side="right")) - 1)
        n = lens[lo:hi]
        first = cum[lo:hi] - cum[lo]
        at = np.arange(int(cum[hi] - cum[lo])) - np.repeat(first, n)
        v = _BYTE[which][fold[data[np.repeat(starts[lo:hi], n) + at]]] * _powers(_STEP[which], int(n.max()))[at]
        out[lo:hi] = np.add.reduceat(v, first)
        lo = hi
    return mix(out ^ lens.astype(np.uint64), which + 1)


def word_slices(texts: pa.Array, inside: np.ndarray, fold: np.ndarray = LOWER, second: bool = False) -> Iterator[Words]:
    """The words of every row of an Arrow string array, for some rows at a time. Null and empty rows have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, off, raw = texts.buffers()
    offs = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + PIECE, side="right")) - 1)
        own = data[offs[lo] : offs[hi]]
        starts, ends = [], []
        at = 0
        while at < len(own):  # a row of many MB in pieces, cut between words where it can be
            to = min(len(own), at + 4 * PIECE)
            if to < len(own):
                gap = np.flatnonzero(~inside[fold[own[to : to + 4 * PIECE]]])
                to = to + int(gap[0]) if len(gap) else len(own)
            s, e = _spans(own[at:to], (offs[lo : hi + 1] - offs[lo]) - at if at == 0 else np.zeros(0, dtype=np.int64), fold, inside)
            starts.append(s + at)
            ends.append(e + at)
            at = to
        s = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
        e = np.concatenate(ends) if ends else np.zeros(0, dtype=np.int64)
        counts = np.diff(np.searchsorted(s, offs[lo : hi + 1] - offs[lo]))
        h = _hash(own, s, e, fold, 0) if len(s) else np.zeros(0, dtype=np.uint64)
        h2 = (_hash(own, s, e, fold, 1) if len(s) else np.zeros(0, dtype=np.uint64)) if second else None
        yield Words(lo, hi, counts, h, h2, s, e, own)
        lo = hi


def grams(hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each run of k neighbouring words, over the whole array (the caller drops runs that cross rows)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * _GRAM[which] + hashes[j : j + n]
    return mix(out, k * 2 + which)


def inside_rows(counts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which runs of k words, by first word, stay inside one row."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows[: n] == rows[k - 1 : k - 1 + n] if n > 0 else np.zeros(0, dtype=bool)


def run_minimum(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w neighbouring values."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64) if h.dtype == np.uint64 else h
