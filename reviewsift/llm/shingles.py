"""Word and shingle hashes of texts, a quarter of a megabyte at a time.

Words are what stands between white space (blank and controls 9 to 13) after A-Z are lower-cased.
A word's hash is a polynomial over its bytes modulo 2**64, mixed; it comes from differences of
running sums, so no loop goes over words. Shingles combine the hashes of neighbouring words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for at least n places."""
    size = 1 << max(n, 1024).bit_length()
    if size not in _tables:
        if size > 4 * _BLOCK:
            _tables.pop(max(_tables, default=0), None)
        base = np.full(size, _BASE, np.uint64)
        back = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        base[0] = back[0] = 1
        _tables[size] = (np.cumprod(base, dtype=np.uint64), np.cumprod(back, dtype=np.uint64))
    return _tables[size]


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word; the data ends with white space."""
    white = _WHITE[data]
    before = np.empty_like(white)
    before[0] = True
    before[1:] = white[:-1]
    starts, stops = np.flatnonzero(before & ~white), np.flatnonzero(white & ~before)
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * down[starts]), starts


def _long(text: bytes) -> np.ndarray:
    """Word hashes of one long text, in pieces that end at white space."""
    data, at, found = np.frombuffer(text + b" ", np.uint8), 0, []
    while at < len(data):
        stop = min(len(data), at + _BLOCK)
        while stop < len(data) and not _WHITE[data[stop - 1]]:
            stop += 1
        found.append(_hashes(data[at:stop])[0])
        at = stop
    return np.concatenate(found)


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, in order."""
    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if group:
            data = np.frombuffer(b" ".join(group) + b" ", np.uint8)
            hashes, starts = _hashes(data)
            edges = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in group)]))
            for first, last in zip(edges[:-1], edges[1:]):
                yield hashes[first:last]
            group.clear()

    for text in texts:
        coded = (text or "").encode("utf-8").lower()
        if len(coded) > _BLOCK:
            yield from flush()
            size = 0
            yield _long(coded)
            continue
        if size + len(coded) > _BLOCK:
            yield from flush()
            size = 0
        group.append(coded)
        size += len(coded) + 1
    yield from flush()


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes in increasing order. A text with fewer words than
    ``width`` has its whole sequence as the only shingle; one without words has none."""
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    for words in word_hashes(texts):
        n = len(words)
        if n == 0:
            yield words
            continue
        many = min(n, width)
        total = np.full(n - many + 1, many, np.uint64)
        for k in range(many):
            total += words[k : n - many + 1 + k] * factors[k]
        yield np.unique(mix(total))
