"""Words, hashes and shingles of many texts at once, as numpy arrays over Arrow's buffers.

A slice of an Arrow batch (about a megabyte of text) is taken as one byte array. A word's hash is
a difference of prefix sums of ``code[byte] * base**position``, moved to position 0 and mixed, so no Python runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: The separators of the words `[^\x20\x09-\x0D]+`.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
#: Separators where punctuation doesn't count either.
_SPACE_PUNCT = _SPACE.copy()
_SPACE_PUNCT[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets) of runs of rows of about ``most`` bytes; null counts as empty."""
    col = batch.column(column)
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


@dataclass
class Words:
    """Of one slice: byte start and end, hash and row of each word, and each row's first word (one more at the end)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; equal bytes have equal hashes wherever they stand."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[data] * _power(_BASE, n)[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * _power(_INVERSE, n + 1)[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True, punctuation: bool = True) -> Words:
    """Words of each row: A-Z lowered if ``fold``; ASCII punctuation belongs to words if ``punctuation``."""
    space = (_SPACE if punctuation else _SPACE_PUNCT)[data]
    inside = ~space
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= space[:-1]
        last[:-1] &= space[1:]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        first[edges] = inside[edges]
        edges = offsets[1:][offsets[1:] > 0] - 1
        last[edges] = inside[edges]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = span_hash(_FOLD[data] if fold else data, start, end)
    bounds = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Words(start, end, hashes, row, bounds)


def run_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words (also those across rows; see ``whole_runs``)."""
    n = max(0, len(hashes) - k + 1)
    total = np.full(n, np.uint64(k), np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * _STEP[j]
    return mix(total)


def whole_runs(w: Words, k: int) -> np.ndarray:
    """Whether each run of ``k`` words lies in one row."""
    n = max(0, len(w.row) - k + 1)
    return w.row[:n] == w.row[k - 1 : k - 1 + n] if n else np.zeros(0, bool)


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Each row's sorted set of hashes of ``k``-word shingles; a row of fewer words has its whole sequence as one."""
    runs = {k: run_hash(w.hash, k)}
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        m = b - a
        if m >= k:
            out.append(np.unique(runs[k][a : b - k + 1]))
        elif m:
            if m not in runs:
                runs[m] = run_hash(w.hash, m)
            out.append(runs[m][a : a + 1])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
