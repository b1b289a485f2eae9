"""Operator 1: benchmark decontamination by edit similarity.

Method: the CGK random walk maps a string to a sequence of symbols: at step j it writes the symbol
it stands on and moves on if a random bit of (j, symbol) says so. Strings at a small edit distance
fall back into step with each other, so their sequences differ in few places (Hamming distance).
Bit sampling over those sequences is a locality-sensitive hash: ``bits`` random places are hashed,
in ``walks`` repetitions with walks of their own. Windows begin at *anchors*, words whose first
three bytes belong to a set chosen so that every item has at least ``anchors`` of them (rarest
first); each anchor of an item stands for the item-sized window around it, so an item is found if
any of its anchors meets in any repetition. A walk stops early where its first half of the bits
meets no item. Windows that meet must also be near in a longer walk, place by place; those that
are are compared with the item by exact edit distance (bit-parallel, best substring).

A document is contaminated by an item if some substring of it is within
``floor((1 - similarity) * length)`` edits of the item. Both are lower-cased and their white
space is collapsed first.

The items of a block (``block`` of them at a time) go to all tasks as one compact index; rows never move.

Edge cases: a null or empty text has no hits; null, blank and repeated items are ignored or count
once each; items too short for a full walk use a short one, and items of under ``LEAST`` bytes
must occur unchanged between word borders. Rows with null or repeated ids are judged row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewsift.llm import common
from reviewsift.llm.shingles import mix

SIMILARITY = 0.8
WALKS = 4
BITS = 10
STEPS = 40
SHORT_STEPS = 16
ANCHORS = 14
#: Steps of the longer walk, and the share of them that may differ (unrelated texts: about 0.85).
LONG_STEPS, LONG_APART = 160, 0.6
LEAST = 24
BLOCK = 5_000
#: Items go to every task, so their size is checked.
MOST_BYTES = 64 << 20
SEED = 20_17
_BUFFER = 1 << 19
_SPACE = 32


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8").split())


def edit_within(item: str, masks: dict[str, int], region: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the substring of ``region`` nearest to ``item``, if within ``most`` edits.

    Bit-parallel columns of the edit matrix: bit i of ``up`` and ``down`` says whether row i + 1 is
    one more or one less than row i. A match may begin anywhere, so row 0 stays 0.
    """
    n = len(item)
    every, top = (1 << n) - 1, 1 << (n - 1)
    up, down, now = every, 0, n
    best, end = n, 0
    for at, letter in enumerate(region):
        same = masks.get(letter, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right_up, right_down = down | (every & ~(diagonal | up)), up & diagonal
        if right_up & top:
            now += 1
        elif right_down & top:
            now -= 1
        right_up, right_down = right_up << 1, right_down << 1
        up, down = (right_down | (every & ~(diagonal | right_up))) & every, right_up & diagonal & every
        if now < best:
            best, end = now, at + 1
    return (best, end) if best <= most else None


def letter_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for place, letter in enumerate(item):
        masks[letter] = masks.get(letter, 0) | 1 << place
    return masks


class Walk:
    """One repetition: random moves, sampled places, and the hashes of the items' windows."""

    def __init__(self, seed: int, steps: int, bits: int):
        rng = np.random.default_rng(seed)
        self.moves = rng.integers(0, 2, (steps, 256)).astype(np.int32)
        self.moves[:, 0] = 0  # past the end of a text the walk stands still
        self.sampled = np.zeros(steps, bool)
        self.sampled[rng.choice(steps, bits, replace=False)] = True

        self.half = int(np.flatnonzero(self.sampled.cumsum() == bits - bits // 2)[0]) + 1

    def hashes(self, data: np.ndarray, starts: np.ndarray, likely: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which starts, hash of each window, where its walk ends); with ``likely``, a table of half
        hashes, only of starts whose first half is in it."""
        kept = np.arange(len(starts))
        at = starts.astype(np.int32)
        made = np.zeros(len(at), np.uint32)
        for step, (moves, sampled) in enumerate(zip(self.moves, self.sampled)):
            if step == self.half:
                self.first = mix(made.astype(np.uint64)) >> np.uint64(44)
                if likely is not None:
                    some = likely[self.first]
                    kept, at, made = kept[some], at[some], made[some]
                made = made.astype(np.uint64)
            symbol = data[at]
            if sampled:
                made = made * made.dtype.type(0x1000193) + symbol
            at = at + moves[symbol]
        return kept, mix(made), at


def _words(data: np.ndarray) -> np.ndarray:
    """Starts of words in texts that are joined by zero bytes."""
    border = (data[:-1] == _SPACE) | (data[:-1] == 0)
    return np.flatnonzero(border & (data[1:] != 0) & (data[1:] != _SPACE)) + 1


class Index:
    """Windows of a block of items, and the texts they come from."""

    def __init__(self, items: list[tuple[int, str | None]], similarity: float, walks: int, bits: int, anchors: int):
        named = {(i, normal(t)) for i, t in items}
        self.items = sorted((i, t) for i, t in named if t and i is not None)
        self.texts = [t.decode("utf-8") for _, t in self.items]
        self.masks = [letter_masks(t) for t in self.texts]
        self.most = [int((1 - similarity) * len(t) + 1e-9) for t in self.texts]
        self.tiny = [k for k, (_, t) in enumerate(self.items) if len(t) < LEAST]
        data = np.frombuffer(b"\0" + b"\0".join(t for _, t in self.items) + b"\0" * 4, np.uint8)
        lengths = np.array([len(t) for _, t in self.items], np.int64)
        firsts = 1 + np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
        words = _words(data)
        owner = np.searchsorted(firsts, words, side="right") - 1
        self.chosen = self._choose(data, words, owner, anchors)
        kept = self.chosen[self.pair(data, words)]
        words, owner = words[kept], owner[kept]
        self.levels = []
        short = lengths[owner] < 2 * STEPS if len(words) else np.zeros(0, bool)
        for steps, mine in ((STEPS, ~short), (SHORT_STEPS, short)):
            tables = []
            for k in range(walks if mine.any() else 0):
                walk = Walk(SEED + 100 * steps + k, steps, min(bits, steps))
                _, made, ends = walk.hashes(data, words[mine])
                inside = ends <= (firsts + lengths)[owner[mine]]
                likely = np.zeros(1 << 20, bool)
                likely[walk.first[inside]] = True
                order = np.argsort(made[inside], kind="stable")
                tables.append((walk, made[inside][order], owner[mine][inside][order], words[mine][inside][order], likely))
            self.levels += tables
        self.lengths, self.firsts, self.data = lengths, firsts, data
        self.long = np.random.default_rng(SEED).integers(0, 2, (LONG_STEPS, 256)).astype(np.int32)
        self.long[:, 0] = 0

    @staticmethod
    def pair(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The first three bytes of words, folded to 16 bits."""
        three = data[starts].astype(np.uint32) << 16 | data[starts + 1].astype(np.uint32) << 8 | data[starts + 2]
        return (three * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int32)

    def _near(self, data: np.ndarray, starts: np.ndarray, anchors: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Whether windows of a text and of an item stay near each other on the longer walk, which
        leads from the anchor towards the farther end of the item."""
        kept = np.arange(len(starts))
        first = self.firsts[items].astype(np.int32)
        end = first + self.lengths[items].astype(np.int32)
        way = np.where(end - anchors >= anchors - first, 1, -1).astype(np.int32)
        a, b = starts.astype(np.int32), anchors.astype(np.int32)
        apart, steps = np.zeros(len(a), np.int32), np.zeros(len(a), np.int32)
        for step, moves in enumerate(self.long):
            if step == LONG_STEPS // 4:  # most unrelated windows are far apart by now
                some = np.flatnonzero(apart <= (LONG_APART + 0.15) * steps)
                kept, first, end, way, a, b, apart, steps = (x[some] for x in (kept, first, end, way, a, b, apart, steps))
            x, y = data[a], self.data[b]
            inside = (b < end) & (b >= first)
            apart += inside & (x != y)
            steps += inside
            a, b = a + way * moves[x], b + way * moves[y]
        found = np.zeros(len(starts), bool)
        found[kept[apart <= LONG_APART * steps]] = True
        return found

    def _choose(self, data: np.ndarray, words: np.ndarray, owner: np.ndarray, anchors: int) -> np.ndarray:
        """First bytes of words that serve as anchors: for each item its rarest, until it has enough."""
        chosen = np.zeros(1 << 16, bool)
        pairs = self.pair(data, words)
        counts = np.bincount(pairs, minlength=1 << 16)
        for item in range(len(self.items)):
            own = pairs[owner == item]
            have = int(chosen[own].sum())
            for p in sorted(set(own.tolist()), key=lambda p: (counts[p], p)):
                if have >= anchors:
                    break
                if not chosen[p]:
                    chosen[p] = True
                    have += int((own == p).sum())
        return chosen

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, start, end, distance): the best match of an item near each place where one of
        its windows met; start and end are bytes of the normalised text."""
        data = np.frombuffer(b"\0" + b"\0".join(texts) + b"\0" * 4, np.uint8)
        firsts = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)
        starts = _words(data)
        starts = starts[self.chosen[self.pair(data, starts)]]
        met: set[tuple[int, int, int]] = set()
        for walk, hashes, owner, anchor, likely in self.levels:
            if not len(hashes) or not len(starts):
                continue
            kept, made, _ = walk.hashes(data, starts, likely)
            low, high = np.searchsorted(hashes, made, "left"), np.searchsorted(hashes, made, "right")
            times = high - low
            start = np.repeat(starts[kept], times)
            entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
            item, spot = owner[entry], anchor[entry]
            near = self._near(data, start, spot, item)
            start, item, spot = start[near], item[near], spot[near]
            text = np.searchsorted(firsts, start, side="right") - 1
            begin = (start - firsts[text]) - (spot - self.firsts[item])
            met.update(zip(text.tolist(), item.tolist(), (begin // 16).tolist()))
        seen: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for text, item, near in sorted(met):
            begin = near * 16
            if any(a <= begin <= b for a, b in seen.get((text, item), ())):
                continue
            slack = int(self.lengths[item]) // 4 + 32
            low = max(0, begin - slack)
            region = texts[text][low : begin + int(self.lengths[item]) + slack]
            letters = region.decode("utf-8", "ignore")
            found = edit_within(self.texts[item], self.masks[item], letters, self.most[item])
            if found:
                end = low + len(letters[: found[1]].encode("utf-8"))
                seen.setdefault((text, item), []).append((begin - slack, begin + slack))
                yield text, item, max(0, end - int(self.lengths[item])), end, found[0]
        for item in self.tiny:
            padded = b" " + self.items[item][1] + b" "
            for text, body in enumerate(texts):
                at = (b" " + body + b" ").find(padded)
                if at >= 0:
                    yield text, item, at, at + len(padded) - 2, 0


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Normalised texts in groups of about half a megabyte."""
    first, group, size = 0, [], 0
    for k, text in enumerate(texts):
        group.append(normal(text))
        size += len(group[-1])
        if size >= _BUFFER:
            yield first, group
            first, group, size = k + 1, [], 0
    if group:
        yield first, group


def _sent(items: DataFrame, block: int) -> list[Broadcast]:
    """The items in blocks, on their way to all tasks. They are a benchmark, not a corpus: more than
    ``MOST_BYTES`` of them are refused, and the caller gives them in parts."""
    wanted = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("item_id is not null and text is not null").distinct()
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of items; give them in parts of at most {MOST_BYTES}")
    listed = sorted((r["item_id"], r["text"]) for r in wanted.toLocalIterator())
    return [items.sparkSession.sparkContext.broadcast(listed[k : k + block]) for k in range(0, len(listed), block)]


_made: dict[tuple, Index] = {}


def _indexes(sent: list[Broadcast], similarity: float, walks: int, bits: int, anchors: int) -> list[Index]:
    """The indexes of all blocks, made once per Python worker."""
    found = []
    for items in sent:
        key = (hash(tuple(items.value)), similarity, walks, bits, anchors)
        if key not in _made:
            _made[key] = Index(items.value, similarity, walks, bits, anchors)
        found.append(_made[key])
    return found


def drop_contaminated(df: DataFrame, items: DataFrame, text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of a table, all columns, in which no item occurs."""
    sent = _sent(items, BLOCK)

    def clean(texts: list[str | None]) -> list[bool]:
        kept = [True] * len(texts)
        for first, group in _groups(texts):
            for index in _indexes(sent, similarity, WALKS, BITS, ANCHORS):
                for text, *_ in index.search(group):
                    kept[first + text] = False
        return kept

    return common.keep_rows(df, clean, text_col)


def find_items(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    walks: int = WALKS,
    bits: int = BITS,
    anchors: int = ANCHORS,
    block: int = BLOCK,
) -> DataFrame:
    """One row per input row: ``doc_id`` and ``hits``, an array of (item_id, start, end, distance)."""
    source = common.narrow(df, id_col, text_col)
    sent = _sent(items, block)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int32())]))

    def run(batches):
        indexes = _indexes(sent, similarity, walks, bits, anchors)
        for batch in common.slices(batches):
            hits: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for first, group in _groups(batch.column(1).to_pylist()):
                for index in indexes:
                    for text, item, start, end, distance in index.search(group):
                        hits[first + text].append({"item_id": index.items[item][0], "start": start, "end": end, "distance": distance})
            for row in hits:
                row.sort(key=lambda h: (h["item_id"], h["start"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, kind)], names=["doc_id", "hits"])

    return source.mapInArrow(run, f"doc_id {common.id_type(source)}, hits array<struct<item_id:bigint,start:bigint,end:bigint,distance:int>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether a benchmark item occurs in it, which, and how near."""
    found = find_items(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").alias("n_hits"),
        F.array_distinct(F.col("hits.item_id")).alias("item_ids"),
        F.array_min("hits.distance").alias("least_distance"),
    )
