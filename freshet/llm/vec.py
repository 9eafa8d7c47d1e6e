"""Words of whole Arrow batches as 64-bit numbers, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK = 1 << 20

_rng = np.random.default_rng(20240607)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Each byte's random number; A-Z share those of a-z.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 8 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; null texts have no bytes."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, symbols: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its row): words as in common.WORD, A-Z lowered. symbols: bytes that also end a word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[data] if symbols is None else ~(_SPACE | symbols)[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:]))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, n), out=total[1:])
    h = (total[ends + 1] - total[starts]) * _power(_INVERSE, n)[starts]
    return mix(h), np.searchsorted(offsets, starts, "right") - 1


def shingles(h: np.ndarray, row: np.ndarray, k: int, n_rows: int) -> list[np.ndarray]:
    """Each row's sorted distinct k-word shingles; a row with fewer words has the whole of them as one."""
    bounds = np.searchsorted(row, np.arange(n_rows + 1))
    if len(h) >= k:
        total = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            total = mix(total * np.uint64(3) + h[i : len(h) - k + 1 + i])
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(total[a : b - k + 1]))
        elif b > a:
            x = np.full(1, k - (b - a), np.uint64)
            for i in range(a, b):
                x = mix(x * np.uint64(3) + h[i])
            out.append(mix(x + np.uint64(0x51ED270B)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
