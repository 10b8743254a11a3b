"""Character n-grams of whole texts as hashes, a batch at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import row_slices
from .words import mix

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_STEP = np.uint64(0x5851F42D4C957F2D)


def letters(text: str | None) -> str:
    """The lower-case words of letters, with one space before, between and behind; empty without a letter."""
    out = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if out and not out.replace(" ", "").isalpha():  # superscripts, fractions, Roman and circled numbers are word characters
        out = " ".join("".join(c if c.isalpha() else " " for c in out).split())
    return f" {out} " if out else ""


def code_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, code points of the rows' letters with a zero behind each row, row lengths with it)."""
    for lo, hi in row_slices(texts):
        own = [letters(t) for t in texts.slice(lo, hi - lo).to_pylist()]
        codes = np.frombuffer("".join(t + "\0" for t in own).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        yield lo, hi, codes, np.array([len(t) + 1 for t in own], dtype=np.int64)


def grams(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the n-grams that stay inside a row."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    c = codes.astype(np.uint64)
    h = np.zeros(size, dtype=np.uint64)
    whole = np.ones(size, dtype=bool)
    for j in range(n):
        h = h * _STEP + c[j : j + size]
        whole &= codes[j : j + size] != 0
    at = np.flatnonzero(whole)
    return at, mix(h[at], n)
