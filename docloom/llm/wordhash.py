"""Words and word shingles of Arrow text columns as 64-bit hashes, in numpy.

Words are runs of bytes other than space and tab to carriage return.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_BASE = 0x9E3779B97F4A7C15
_STEP = [int(x) * 2 + 1 for x in _RNG.integers(1, 2**62, 64)]
#: Bytes of text hashed at a time; one longer text is taken alone.
SLICE_BYTES = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


_HELD: dict[tuple, object] = {}


def held(key: tuple, make):
    """The one large model of this Python worker; another operator's is let go, as workers live on."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """For operators without a model: free what another operator has left in this worker."""
    if _HELD:
        _HELD.clear()
        gc.collect()


def trim() -> None:
    """Give freed memory back to the system: an idle worker stays beside the executor's next stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, or more, of an odd number and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of stretches of rows; null texts have no bytes."""
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        stop = min(stop, n)
        yield row, offsets[row : stop + 1] - offsets[row], data[offsets[row] : offsets[stop]]
        row = stop


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and one past the last) of all words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = _WORD[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    before[cuts] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """fold: A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTE)[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of the words i to i + width - 1 at i, over all rows in a stretch."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    n = len(hashes) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out += hashes[k : k + n] * np.uint64(_STEP[k])
    return mix(out)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each row its sorted distinct hashes of folded shingles; a shorter text with words is one shingle."""
    for _, offsets, data in text_slices(column):
        starts, ends, first = words(offsets, data)
        hashes = word_hashes(data, starts, ends)
        shingles = windows(hashes, width)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(shingles[a : b - width + 1])
            elif b > a:
                yield windows(hashes[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)
