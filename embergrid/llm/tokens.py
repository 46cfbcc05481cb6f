"""Token ids by the tokenizers library, remembered chunk by chunk.

A byte-level BPE of this kind first splits texts into runs of letters, of digits, of other marks (each with a space
before it) and of white space, and never merges across. Texts are cut where such a split is certain: before a space that another
character follows, between a letter and a mark, and around a single line feed. Each distinct chunk is encoded once per Python worker by the library, and a document's ids are
gathered from the remembered ones, so they are those of encoding the whole text. With ``special``, an added token's string
in a text is a chunk of its own and gets that token's id, as the library does it; else it is text as any other. Chunks are found by 128 bits of
hash, for many texts at once; at most ``max_entries`` are remembered (2^18: some 20 MB a worker), and the library encodes the others each time.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np

from .common import CACHES, single_thread
from .shingles import groups, mix

_U = np.uint64
LONG = 64  # bytes; longer chunks are not remembered
#: Whether a space before this byte begins a chunk: not before white space, nor before bytes that may begin white space in UTF-8.
BEGINS = np.ones(256, bool)
BEGINS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = False
_LETTER, _MARK, _SOLID = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[list(b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')] = True  # without the apostrophe of contractions
_SOLID[33:127] = True
_LATIN = np.zeros(256, bool)  # second bytes of the letters from U+00C0 to U+00FF
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_RANDOM = np.random.Generator(np.random.PCG64(20240301))
_BYTES = [_RANDOM.integers(1, 1 << 63, 256, np.uint64) * _U(2) + _U(1) for _ in range(2)]
_BASES = [0x9E3779B97F4A7C15, 0xD1B54A32D192ED03]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkTable:
    """Open addressing from 64-bit hashes to entry numbers, for whole arrays at a time."""

    def __init__(self):
        self.keys, self.entries, self.used = np.zeros(1 << 16, _U), np.zeros(1 << 16, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        mask = _U(len(self.keys) - 1)
        at, left = (h & mask).astype(np.int64), np.arange(len(h))
        while len(left):
            k = self.keys[at]
            hit = k == h[left]
            out[left[hit]] = self.entries[at[hit]]
            on = ~hit & (k != 0)
            left, at = left[on], (at[on] + 1) & int(mask)
        return out

    def add(self, h: np.ndarray, entry: np.ndarray) -> None:
        """h: distinct and not in the table."""
        if 2 * (self.used + len(h)) > len(self.keys):
            full = self.keys != 0
            old, numbers = self.keys[full], self.entries[full]
            size = len(self.keys)
            while 2 * (self.used + len(h)) > size:
                size *= 2
            self.keys, self.entries, self.used = np.zeros(size, _U), np.zeros(size, np.int32), 0
            self._put(old, numbers)
        self._put(h, entry)

    def _put(self, h: np.ndarray, entry: np.ndarray) -> None:
        mask = len(self.keys) - 1
        self.used += len(h)
        at = (h & _U(mask)).astype(np.int64)
        while len(h):
            free = self.keys[at] == 0
            slots, first = np.unique(at[free], return_index=True)
            mine = np.flatnonzero(free)[first]
            self.keys[slots], self.entries[slots] = h[mine], entry[mine]
            on = np.ones(len(h), bool)
            on[mine] = False
            h, entry, at = h[on], entry[on], (at[on] + 1) & mask


class ChunkMemo:
    """Ids of texts that are cut into chunks, each distinct chunk being encoded once. A subclass says where texts may be cut
    (``starts``) and what the ids of chunks are (``chunk_ids``)."""

    def __init__(self, max_entries: int):
        single_thread()
        self.max_entries, self.known = max_entries, ChunkTable()
        self.begin, self.size, self.check, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(1024, _U), np.zeros(4096, np.int32)
        self.n = self.ids = 0  # entries and ids in use
        self._powers(1 << 19)

    def starts(self, raw: np.ndarray, first: np.ndarray, stop: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Per byte of the joined texts, which begin at `first` and end at `stop`: whether a chunk may begin here."""
        raise NotImplementedError

    def chunk_ids(self, chunks: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def _powers(self, n: int) -> None:
        self.up, self.down = ([np.cumprod(np.concatenate([[_U(1)], np.full(n, b, _U)]), dtype=_U) for b in bases] for bases in (_BASES, [pow(b, -1, 1 << 64) for b in _BASES]))

    def _hashes(self, raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        if len(raw) >= len(self.up[0]):
            self._powers(2 * len(raw))
        out = []
        for value, up, down in zip(_BYTES, self.up, self.down, strict=True):
            sums = np.empty(len(raw) + 1, _U)
            sums[0] = 0
            np.cumsum(value[raw] * up[: len(raw)], out=sums[1:])
            out.append(mix((sums[end] - sums[first]) * down[first]))
        out[0][out[0] == 0] = 1
        return out

    def _learn(self, chunks: list[bytes], h: np.ndarray, check: np.ndarray) -> None:
        """Append the ids of new chunks; those that are short, while there is room, can be found again."""
        ids = self.chunk_ids(chunks)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        n, total = self.n + len(ids), self.ids + int(size.sum())
        for name, need in (("begin", n), ("size", n), ("check", n), ("flat", total)):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(need, 2 * len(old)) - len(old), old.dtype)]))
        self.begin[self.n : n], self.size[self.n : n], self.check[self.n : n] = self.ids + np.cumsum(size) - size, size, check
        self.flat[self.ids : total] = np.fromiter(chain.from_iterable(ids), np.int32, total - self.ids)
        keep = np.flatnonzero((np.fromiter(map(len, chunks), np.int64, len(chunks)) <= LONG) & (np.arange(self.n, n) < self.max_entries))
        self.known.add(h[keep], keep + self.n)
        self.n, self.ids = n, total

    def _encode_group(self, texts: list[bytes], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        long = np.fromiter(map(len, texts), np.int64, len(texts))
        stop, last = np.cumsum(long), int(end is not None)
        begins = self.starts(raw, stop - long, stop, texts)
        begins[(stop - long)[long > 0]] = True
        first = np.flatnonzero(begins)
        close = np.append(first[1:], len(raw)) if len(first) else first
        counts = np.searchsorted(first, stop) - np.searchsorted(first, stop - long)
        h, check = self._hashes(raw, first, close)
        entry = self.known.find(h)
        entry[(entry >= 0) & (self.check[entry] != check)] = -1
        missing = np.flatnonzero(entry < 0)
        before = self.n, self.ids
        if len(missing):
            _, at, back = np.unique(h[missing], return_index=True, return_inverse=True)
            at = missing[at]
            brief = np.argsort(close[at] - first[at] > LONG, kind="stable")  # chunks to forget come last
            place = np.empty(len(at), np.int64)
            place[brief] = np.arange(len(at))
            at = at[brief]
            joined = raw.tobytes()
            self._learn([joined[a:b] for a, b in zip(first[at].tolist(), close[at].tolist(), strict=True)], h[at], check[at])
            entry[missing] = before[0] + place[back]
        size = self.size[entry].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        out = np.full(total + last * len(texts), end or 0, np.int32)
        ids = self.flat[np.repeat(self.begin[entry] - (ends - size), size) + np.arange(total)]
        sums = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        per = np.diff(sums)
        if last:
            own = np.ones(len(out), bool)
            own[np.cumsum(per + 1) - 1] = False
            out[own] = ids
        else:
            out = ids
        if len(missing):  # what cannot be found again is dropped
            stay = max(before[0], min(self.max_entries, before[0] + int((close[at] - first[at] <= LONG).sum())))
            if stay < self.n:
                self.n, self.ids = stay, int(self.begin[stay])
        return out, per + last

    def encode_many(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """int32 ids of the whole texts one after the other, each followed by `end`; and how many each has."""
        parts = [self._encode_group(g, end) for g in groups(texts)]
        return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in ((0, np.int32), (1, np.int64)))

    def encode(self, text: str, end: int | None = None) -> np.ndarray:
        return self.encode_many([text.encode()], end)[0]


class ChunkTokenizer(ChunkMemo):
    """Ids of the tokenizers library for byte-level BPE; any other kind of tokenizer is refused, as the cuts would be wrong for it."""

    def __init__(self, path: str, max_entries: int = 1 << 18, special: bool = False):
        super().__init__(max_entries)
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        kind = json.loads(self.tokenizer.to_str())
        split = kind["pre_tokenizer"] or {}
        if kind["normalizer"] or kind["model"].get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level BPE without a normalizer or a prefix space can be cut into chunks")
        added = list(self.tokenizer.get_added_tokens_decoder().values()) if special else []
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("an added token takes in what stands beside it")
        self.added = re.compile(b"|".join(re.escape(t.content.encode()) for t in sorted(added, key=lambda t: -len(t.content)))) if added else None

    def chunk_ids(self, chunks: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]

    def starts(self, raw: np.ndarray, first: np.ndarray, stop: np.ndarray, texts: list[bytes]) -> np.ndarray:
        begins = np.zeros(len(raw), bool)
        begins[:-1] = (raw[:-1] == 32) & BEGINS[raw[1:]]
        begins[stop[stop > first] - 1] = False
        spans = [(a + m.start(), a + m.end()) for a, t in zip(first.tolist(), texts, strict=True) for m in self.added.finditer(t)] if self.added else []
        begins[[a - 1 for a, _ in spans if a]] = False  # a text ends where an added token begins
        letter = _LETTER[raw]
        letter[1:] |= (raw[:-1] == 0xC3) & _LATIN[raw[1:]]
        begins[1:] |= letter[:-1] & _MARK[raw[1:]]
        line = 1 + np.flatnonzero((raw[1:-1] == 10) & (letter[:-2] | _SOLID[raw[:-2]]) & BEGINS[raw[2:]])
        begins[line] = begins[line + 1] = True
        for a, b in spans:
            begins[a + 1 : b] = False
            begins[a : b + 1 : b - a] = True
        return begins


TOKENIZERS: dict[tuple[str, bool], ChunkTokenizer] = {}
CACHES.append(TOKENIZERS)


def tokenizer(path: str, special: bool = False) -> ChunkTokenizer:
    """One for each Python worker."""
    if (path, special) not in TOKENIZERS:
        TOKENIZERS[path, special] = ChunkTokenizer(path, special=special)
    return TOKENIZERS[path, special]
