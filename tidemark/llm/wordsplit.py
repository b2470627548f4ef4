"""Splitting of text for byte-level BPE, over whole batches at once.

The split is that of ``public_tokenizers.PATTERN``: contractions, runs of
letters, digits or other signs with at most one leading space, and white space.
It is computed with array operations over the code points of many texts, and
each piece gets a 64-bit polynomial hash, so that the tokenizer library has to
see each distinct piece only once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex

CHUNK = 1 << 19
#: Pieces longer than this are never looked up by hash.
LONGEST = 256
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


@lru_cache(None)
def char_classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    low = "".join(map(chr, range(0xD800)))
    high = "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for base, chars in ((0, low), (0xE000, high)):
            for m in regex.finditer(pattern, chars):
                table[base + m.start() : base + m.end()] = kind
    return table


@lru_cache(None)
def _mixed() -> np.ndarray:
    x = np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = 1 << max(20, int(n).bit_length())
        for name, base in (("p", _P), ("q", _PINV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["p"], _powers["q"]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal spans anywhere have equal hashes."""
    p, q = powers(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_mixed()[points] * p[: len(points)], out=total[1:])
    return (total[ends] - total[starts]) * q[starts] ^ ((ends - starts).astype(np.uint64) << np.uint64(48))


@lru_cache(None)
def _check_powers() -> np.ndarray:
    x = np.full(LONGEST + 1, 0xD6E8FEB86659FD93 | 1, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


def span_checks(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Other 64-bit hashes of (not empty) spans, which tell apart those whose first
    hashes agree by chance.  Made for the few distinct spans of a text only."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    heads = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(heads, size)
    signs = points[np.repeat(starts, size) + at].astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(0xE7037ED1A0B428DB)
    signs ^= signs >> np.uint64(32)
    return np.add.reduceat(signs * _check_powers()[np.minimum(at, LONGEST)], heads) ^ size.astype(np.uint64)


def safe_cuts(text: str, chunk: int = CHUNK) -> Iterator[str]:
    """Parts of a long text, cut only where white space follows other signs,
    which always ends a piece."""
    at = 0
    pattern = regex.compile(r"(?<=\P{White_Space})\p{White_Space}")
    while len(text) - at > chunk:
        m = pattern.search(text, at + chunk)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def chunks(texts: list[str], chunk: int = CHUNK) -> Iterator[tuple[list[int], list[str]]]:
    """(number of the text, part) lists of about ``chunk`` characters."""
    owners: list[int] = []
    parts: list[str] = []
    size = 0
    for k, text in enumerate(texts):
        for part in safe_cuts(text, chunk) if len(text) > chunk else (text,):
            if parts and size + len(part) > chunk:
                yield owners, parts
                owners, parts, size = [], [], 0
            owners.append(k)
            parts.append(part)
            size += len(part)
    if parts:
        yield owners, parts


def pieces(parts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Joined text, starts and ends of all pieces, and hashes; no piece crosses parts."""
    joined = "".join(parts)
    c = code_points(joined)
    n = len(c)
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    heads = np.cumsum(lens) - lens
    if not n:
        none = np.zeros(0, np.int64)
        return joined, none, none, none.astype(np.uint64)
    cls = char_classes()[c]
    first = np.zeros(n + 1, bool)
    first[heads[lens > 0]] = True
    first[n] = True
    run = first.copy()
    run[1:n] |= cls[1:] != cls[:-1]
    space = cls == SPACE
    joins = np.zeros(n, bool)  # a blank that leads the next run
    joins[:-1] = (c[:-1] == 32) & ~first[1:n] & ~space[1:]
    start = run[:n].copy()
    start[1:] &= ~joins[:-1]
    last_blank = np.zeros(n, bool)  # last white space before other signs
    last_blank[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    start |= last_blank
    quotes = np.flatnonzero((c == 39) & start & (cls == OTHER))
    for i in quotes:
        rest = joined[i + 1 : i + 3]
        stop = int(heads[np.searchsorted(heads, i, "right") - 1] + lens[np.searchsorted(heads, i, "right") - 1])
        k = 2 if rest[:1] in ("s", "t", "m", "d") and rest else 3 if rest in ("re", "ve", "ll") else 0
        if k and i + k <= stop:
            start[i + 1 : i + k] = False
            if i + k < n:
                start[i + k] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    return joined, starts, ends, span_hashes(c, starts, ends)


class HashTable:
    """64-bit keys to places, in two arrays: a fifth of a dictionary's memory.
    Whole arrays of keys are looked up and put in at once, by linear probing."""

    def __init__(self, bits: int = 16):
        self.bits, self.count = bits, 0
        self.keys, self.places = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int64)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            place = self.places[at]
            hit = (place >= 0) & (self.keys[at] == keys[todo])
            out[todo[hit]] = place[hit]
            on = (place >= 0) & ~hit
            todo, at = todo[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Put in distinct keys that aren't there."""
        if (self.count + len(keys)) * 10 > 7 << self.bits:
            old_keys, old = self.keys, self.places
            while (self.count + len(keys)) * 10 > 7 << self.bits:
                self.bits += 1
            self.count = 0
            self.keys, self.places = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            self.add(old_keys[old >= 0], old[old >= 0])
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = np.flatnonzero(self.places[at] < 0)
            slots, first = np.unique(at[free], return_index=True)  # one key for each free slot
            won = free[first]
            self.keys[slots], self.places[slots] = keys[todo[won]], places[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, at = todo[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
        self.count += len(keys)


class PieceCoder:
    """Ids of whole texts; each distinct piece goes to ``encode`` once.  A piece is
    known again by two hashes; if only the first one agrees, it is encoded by itself.

    ``encode`` maps a list of pieces to a list of id lists.  The table of known
    pieces is emptied when it holds ``limit`` of them, or their ids are very many,
    which bounds memory.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = 1_200_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.known = HashTable()
        self.pool = np.zeros(1 << 20, np.uint32)
        self.used = 0
        self.off = np.zeros(1 << 16, np.int32)
        self.len = np.zeros(1 << 16, np.int32)
        self.check = np.zeros(1 << 16, np.uint64)
        self.count = 0

    def _add(self, ids: list[list[int]]) -> np.ndarray:
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(lens.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.count + len(ids) > len(self.off):
            self.off, self.len, self.check = (np.concatenate([x, np.zeros_like(x)]) for x in (self.off, self.len, self.check))
        self.pool[self.used : self.used + total] = np.fromiter((y for x in ids for y in x), np.uint32, total)
        slots = np.arange(self.count, self.count + len(ids))
        self.off[slots] = self.used + np.cumsum(lens) - lens
        self.len[slots] = lens
        self.used += total
        self.count += len(ids)
        return slots

    def slots(self, joined: str, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        if self.count > self.limit or self.used > 1 << 24:
            self.clear()
        codes, keys = pd.factorize(hashes)
        at = np.zeros(len(keys), np.int64)
        at[codes[::-1]] = np.arange(len(codes))[::-1]
        slot = self.known.find(keys)
        check = span_checks(code_points(joined), starts[at], ends[at])
        other = slot >= 0
        other[other] = self.check[slot[other]] != check[other]  # another piece with the same hash
        missing = np.flatnonzero((slot < 0) | other)
        if len(missing):
            where = at[missing]
            new = self._add(self.encode([joined[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]))
            self.check[new] = check[missing]
            slot[missing] = new
            fresh = ~other[missing]
            self.known.add(keys[missing][fresh], new[fresh])
        out = slot[codes]
        long = np.flatnonzero(ends - starts > LONGEST)
        if len(long):
            out[long] = self._add(self.encode([joined[starts[i] : ends[i]] for i in long]))
        return out

    def ids(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, its ids as uint32), in order, every text once."""
        open_at, held = -1, []
        empty = np.zeros(0, np.uint32)
        for owners, parts in chunks(texts):
            joined, starts, ends, hashes = pieces(parts)
            slot = self.slots(joined, starts, ends, hashes)
            lens = self.len[slot].astype(np.int64)
            upto = np.cumsum(lens)
            total = int(upto[-1]) if len(upto) else 0
            flat = self.pool[np.repeat(self.off[slot] - (upto - lens), lens) + np.arange(total)]
            heads = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
            stops = np.concatenate([[0], upto])[np.searchsorted(starts, heads)]
            begin = 0
            for owner, stop in zip(owners, stops.tolist(), strict=True):
                if owner != open_at and open_at >= 0:
                    yield open_at, held[0] if len(held) == 1 else np.concatenate(held)
                    held = []
                open_at = owner
                held.append(flat[begin:stop])
                begin = stop
        if open_at >= 0:
            yield open_at, np.concatenate(held) if held else empty


def hf_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Pieces to ids by the tokenizers library; special strings are plain text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda words: [e.ids for e in t.encode_batch_fast(words, add_special_tokens=False)]


_coders: dict[str, PieceCoder] = {}


def hf_coder(path: str) -> PieceCoder:
    """One coder for each worker process and vocabulary file."""
    if path not in _coders:
        _coders[path] = PieceCoder(hf_encoder(path))
    return _coders[path]
