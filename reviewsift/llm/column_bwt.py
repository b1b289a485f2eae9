"""Column-wise construction of the Burrows-Wheeler transform of a collection of strings.

Each round puts one symbol of every string in front of the suffix inserted last, so after round j
all suffixes of up to j symbols stand in order. A suffix is a record (string, length, common
prefix with its predecessor, symbol before it); records live in sequential files, one per column,
that are read twice and written once per round. Where a new suffix belongs follows from the symbol counts up to
the place of its tail (LF mapping); its common prefix is one more than the least common prefix
since the last occurrence of its symbol, and the record behind it is corrected likewise. Both are
carried from block to block of the file, so memory is one block plus a few numbers per string.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Records of a block, and bytes that a file keeps in memory before it goes to disk.
BLOCK = 1 << 20
IN_MEMORY = 32 << 20
_NONE = 255


#: Columns of a record: string and length packed, common prefix, symbol before.
Records = tuple[np.ndarray, np.ndarray, np.ndarray]


class _File:
    """Sequential files of the three columns: in memory while small, then on the task's scratch disk."""

    def __init__(self, packed: type) -> None:
        self.types = (packed, np.uint8, np.uint8)
        self.parts: list[Records] = []
        self.disk: list | None = None
        self.size = 0

    def write(self, records: Records) -> None:
        self.size += len(records[0])
        if self.disk is None:
            self.parts.append(records)
            if 8 * self.size <= IN_MEMORY:
                return
            self.disk = [tempfile.TemporaryFile() for _ in records]
            for part in self.parts:
                self._append(part)
            self.parts = []
        else:
            self._append(records)

    def _append(self, records: Records) -> None:
        for file, column in zip(self.disk, records):
            file.write(np.ascontiguousarray(column).data)

    def blocks(self) -> Iterator[tuple[int, Records]]:
        at = 0
        if self.disk is None:
            for part in self.parts:
                for k in range(0, len(part[0]), BLOCK):
                    records = tuple(column[k : k + BLOCK] for column in part)
                    yield at, records
                    at += len(records[0])
            return
        for file in self.disk:
            file.seek(0)
        while at < self.size:
            records = tuple(np.frombuffer(file.read(BLOCK * np.dtype(kind).itemsize), kind) for file, kind in zip(self.disk, self.types))
            yield at, records
            at += len(records[0])

    def close(self) -> None:
        for file in self.disk or ():
            file.close()


def _merged(old: Records, places: np.ndarray, new: Records) -> Records:
    """Records with new ones at ``places`` of the result."""
    kept = np.ones(len(old[0]) + len(places), bool)
    kept[places] = False
    out = []
    for before, added in zip(old, new):
        column = np.empty(len(kept), before.dtype)
        column[kept] = before
        column[places] = added
        out.append(column)
    return tuple(out)


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of ``values[first..last]`` for each range; long ranges go over blocks of 64."""
    found = np.empty(len(first), np.uint8)
    padded = np.append(values, np.uint8(_NONE))
    long = last - first > 256
    short = ~long
    if short.any():
        edges = np.empty(2 * int(short.sum()), np.int64)
        edges[0::2], edges[1::2] = first[short], last[short] + 1
        found[short] = np.minimum.reduceat(padded, edges)[0::2]
    if long.any():
        whole = np.append(np.minimum.reduceat(values, np.arange(0, len(values), 64)), np.uint8(_NONE))
        a, b = first[long], last[long]
        high, low = a // 64 + 1, b // 64
        edges = np.empty(2 * len(a), np.int64)
        edges[0::2], edges[1::2] = high, low
        inner = np.minimum.reduceat(whole, edges)[0::2]
        edges[0::2], edges[1::2] = a, high * 64
        left = np.minimum.reduceat(padded, edges)[0::2]
        edges[0::2], edges[1::2] = low * 64, b + 1
        right = np.minimum.reduceat(padded, edges)[0::2]
        found[long] = np.minimum(np.minimum(left, right), inner)
    return found


def suffixes(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (string, length, common prefix up to ``most``, symbol before) in suffix order.

    ``text`` holds the strings' bytes (below 255) at ``starts``. Empty suffixes come first. The
    symbol before a suffix is its byte plus one, or 0 if the suffix is its whole string.
    """
    n = len(starts)
    symbol = lambda strings, length: np.where(
        lengths[strings] > length, text[np.maximum(starts[strings] + lengths[strings] - 1 - length, 0)].astype(np.int64) + 1, 0
    )
    every = np.arange(n)
    packed = np.uint32 if n < 1 << 24 else np.uint64
    pack = lambda strings, length: (strings << 8 | length).astype(packed)
    file = _File(packed)
    before = symbol(every, 0)
    file.write((pack(every, 0), np.zeros(n, np.uint8), before.astype(np.uint8)))
    counts = np.bincount(before, minlength=256)
    active, places = every, every.astype(np.int64)
    for length in range(1, int(lengths.max(initial=0)) + 1):
        own = lengths[active] >= length
        active, places = active[own], places[own]
        base = n + np.cumsum(counts) - counts - counts[0]
        new_places = np.empty(len(active), np.int64)
        new_common = np.empty(len(active), np.uint8)
        fixed_places, fixed_common = [], []
        so_far = np.zeros(256, np.int64)
        since = np.zeros(256, np.uint8)
        seen = np.zeros(256, bool)
        pending = np.zeros(256, bool)
        for at, (_, common, bwt) in file.blocks():
            size = len(bwt)
            low, high = np.searchsorted(places, [at, at + size])
            mine = places[low:high] - at
            order = np.argsort(bwt, kind="stable")
            here = counts if size == file.size else np.bincount(bwt, minlength=256)
            first_of = np.cumsum(here) - here
            fresh = np.zeros(size, bool)
            fresh[mine] = True
            number = np.empty(size, np.int32)
            number[mine] = np.arange(low, high)
            # Occurrences whose common prefix is wanted: new ones, and those behind new ones.
            flags = np.zeros(size + 1, bool)
            flags[:-1] = fresh[order]
            flags[1:] |= flags[:-1].copy()
            flags[first_of[(here > 0) & pending]] = True
            wanted = np.flatnonzero(flags[:-1])
            to = order[wanted]
            kind = bwt[to].astype(np.int64)
            is_first = wanted == first_of[kind]
            is_fresh = fresh[to]
            # The successor of the last occurrence of a symbol is one of another symbol: left alone.
            use = (kind > 0) & (~is_first | is_fresh | pending[kind])
            wanted, to, kind, is_first, is_fresh = wanted[use], to[use], kind[use], is_first[use], is_fresh[use]
            start = np.where(is_first, 0, order[np.maximum(wanted - 1, 0)] + 1)
            least = _least(common, start, to) if len(to) else np.zeros(0, np.uint8)
            least = np.where(is_first & seen[kind], np.minimum(least, since[kind]), least)
            value = np.where(is_first & ~seen[kind], 0, np.minimum(least.astype(np.int64) + 1, most)).astype(np.uint8)
            landing = base[kind] + so_far[kind] + wanted - first_of[kind]
            new_places[number[to[is_fresh]]] = landing[is_fresh]
            new_common[number[to[is_fresh]]] = value[is_fresh]
            fixed_places.append(landing[~is_fresh])
            fixed_common.append(value[~is_fresh])
            if at + size < file.size:  # carry over to the next block
                present = np.flatnonzero(here)
                last = order[first_of[present] + here[present] - 1]
                pending[present] = fresh[last]
                since = np.minimum(since, common.min())
                tail = np.minimum.accumulate(common[::-1])[::-1]
                since[present] = np.append(tail, np.uint8(_NONE))[last + 1]
                seen[present] = True
                so_far += here
        order = np.argsort(new_places, kind="stable")
        active, places, new_common = active[order], new_places[order], new_common[order]
        before = symbol(active, length)
        inserted = (pack(active, length), new_common, before.astype(np.uint8))
        counts = counts + np.bincount(before, minlength=256)
        into = places - np.arange(len(places))
        fixes = np.concatenate(fixed_places) if fixed_places else np.zeros(0, np.int64)
        values = np.concatenate(fixed_common) if fixed_common else np.zeros(0, np.uint8)
        by_place = np.argsort(fixes, kind="stable")
        fixes, values = fixes[by_place], values[by_place]
        after = _File(packed)
        done = 0
        for at, records in file.blocks():
            size = len(records[0])
            stop = len(places) if at + size == file.size else int(np.searchsorted(into, at + size))
            offset = at + done
            merged = _merged(records, places[done:stop] - offset, tuple(column[done:stop] for column in inserted))
            low, high = np.searchsorted(fixes, [offset, offset + len(merged[0])])
            merged[1][fixes[low:high] - offset] = values[low:high]
            after.write(merged)
            done = stop
        file.close()
        file = after
    for _, (strings, common, before) in file.blocks():
        yield (strings >> packed(8)).astype(np.int64), (strings & packed(255)).astype(np.int64), common, before
    file.close()
