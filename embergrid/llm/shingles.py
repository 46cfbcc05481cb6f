"""64-bit hashes of words and word shingles, vectorised over the bytes of many texts.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A shingle is five words in a row; a text of fewer words, but not
none, has its whole sequence as its only shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
GROUP_BYTES = 1 << 18
_U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_RANDOM = np.random.Generator(np.random.PCG64(20240229))  # the same everywhere: the hash is a fixed function
_BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _RANDOM.integers(1, 1 << 63, 64, np.uint64) * _U(2) + _U(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(GROUP_BYTES * 2, 1 << max(1, n).bit_length())
    if size not in _powers:
        _powers.clear()
        _powers[size] = tuple(np.cumprod(np.concatenate([[_U(1)], np.full(size, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE))
    return _powers[size]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one more entry at the end)."""
    joined = b" ".join([*texts, b""]) or b" "
    raw = np.frombuffer(joined, np.uint8)
    up, down = powers(len(raw))
    edges = np.flatnonzero(np.diff(_IS_SPACE[raw], prepend=True, append=True))
    first, end = edges[::2], edges[1::2]
    sums = np.concatenate([[_U(0)], np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)])
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return mix((sums[end] - sums[first]) * down[first]), np.searchsorted(first, begin)


def groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts a quarter of a megabyte at a time: arrays stay small, and in the cache."""
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t)
        if size >= GROUP_BYTES:
            yield out
            out, size = [], 0
    if out:
        yield out


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """Per text: its sorted distinct shingle hashes."""
    for group in groups(texts):
        words, at = word_hashes(group)
        n = len(words) - width + 1
        if n > 0:
            total = words[:n] * _PLACE[0]
            for k in range(1, width):
                total += words[k : k + n] * _PLACE[k]
            total = mix(total)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= width:
                s = np.sort(total[a : b - width + 1])
                yield s if len(s) == 1 else s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                yield mix((words[a:b] * _PLACE[width : width + b - a]).sum(dtype=np.uint64, keepdims=True) + _PLACE[32 + b - a])
            else:
                yield words[:0]
