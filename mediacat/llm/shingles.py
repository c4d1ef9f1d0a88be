"""Hashes of word shingles, worked out over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SLICE_BYTES = 1 << 20

_random = np.random.default_rng(7)
_BYTE = _random.integers(1, 2**64 - 1, 256, dtype=_U)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_PLACE = _random.integers(1, 2**63 - 1, 64, dtype=_U) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(name: str, base: int, size: int) -> np.ndarray:
    if len(_powers[name]) < size:
        grown = np.full(max(size, _SLICE_BYTES), base, _U)
        grown[0] = 1
        _powers[name] = np.cumprod(grown)
    return _powers[name][:size]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and where the words of each text begin.

    ``data`` are the UTF-8 bytes of the texts, ``bounds`` where each begins and the last
    ends. Words are runs of anything but ASCII white space; A-Z equal a-z.
    """
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(bounds), np.int64)
    inside = ~_SPACE[data]
    before = np.r_[False, inside[:-1]]
    after = np.r_[inside[1:], False]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after)
    total = np.cumsum(_BYTE[data] * _power("up", _BASE, len(data)))
    head = np.where(starts > 0, total[starts - 1], _U(0))
    words = mix((total[ends] - head) * _power("down", _INVERSE, len(data))[starts])
    return words, np.searchsorted(starts, bounds)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of every text, ascending.

    A text of fewer words than ``size`` has one shingle, its whole word sequence; a NULL
    text or one without words has none. Two shingles with one hash would count as the same,
    which for 64 bits is left to chance.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, places, raw = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    sets: list[np.ndarray] = []
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _SLICE_BYTES, side="right")) - 1)
        bounds = offsets[at : to + 1] - offsets[at]
        words, first = word_hashes(data[offsets[at] : offsets[to]], bounds)
        whole = np.zeros(max(0, len(words) - size + 1), _U)
        for k in range(size):
            whole += words[k : k + len(whole)] * _PLACE[k]
        whole = mix(whole)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= size:
                sets.append(np.unique(whole[a : b - size + 1]))
            elif b > a:
                short = (words[a:b] * _PLACE[: b - a]).sum(dtype=_U, keepdims=True)
                sets.append(mix(short ^ _U(b - a)))
            else:
                sets.append(np.zeros(0, _U))
        at = to
    return sets


def signature(shingles: np.ndarray) -> int:
    """One number for a set of shingles, as a signed 64-bit integer."""
    return int(mix(mix(shingles ^ _U(_INVERSE)).sum(dtype=_U, keepdims=True) + _U(len(shingles))).view(np.int64)[0])
