"""Byte-level text kernels shared by the Python-side operators.

Texts travel as UTF-8 ``binary`` columns.  ``bytes.split()`` cuts at exactly
``[\\x20\\x09-\\x0D]+`` and ``bytes.lower()`` touches exactly ``A-Z``, which is
how the operators define words and case.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
U64 = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijective 64-bit mixer."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@functools.cache
def _byte_codes() -> np.ndarray:
    return splitmix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, up to n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=U64)
    return _POWERS["up"], _POWERS["down"]


_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """One 64-bit hash for each word of the text, in order, without a loop over words."""
    n = len(text)
    if not n:
        return np.empty(0, U64)
    raw = np.frombuffer(text, np.uint8)
    edge = np.diff(_IS_WORD[raw].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(_byte_codes()[_LOWER[raw] if lower else raw] * up[:n], out=total[1:])
    return splitmix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


_STEP = [int(x) | 1 for x in splitmix(np.arange(101, 165, dtype=U64))]


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows; a text with fewer words is one window, an empty one has none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = words[: n - k + 1] * U64(_STEP[0])
    for j in range(1, k):
        out += words[j : n - k + 1 + j] * U64(_STEP[j])
    return splitmix(out + U64(k))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text, lower-cased (A-Z)."""
    return np.unique(window_hashes(word_hashes(text or b""), k))


def binary_rows(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The record batches with their texts as bytes, null as empty, in portions of bounded size."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        for at in range(0, batch.num_rows, 512):
            part = column.slice(at, 512)
            yield batch.slice(at, 512), [x or b"" for x in part.to_pylist()]


def table(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
