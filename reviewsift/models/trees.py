"""Decision trees on binned numbers, as number arrays: growing and walking them inside one task.

A table of numbers becomes a matrix of bytes: for each cell, how many of the feature's cuts lie below
it. A tree is grown level by level, all open nodes of a level at once. The rows of a node stand side by
side, so a level costs what its open nodes hold, however many nodes that is. Nodes of many rows
count their rows by bin; nodes of few rows are sorted instead, padded to a common length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

BINS = 32
#: Nodes with more rows than this are split by counts per bin, others by sorting their rows.
SORTED = 64
#: Cells that a step of a level works on at a time.
CELLS = 1 << 19
#: A sorted cell is bin, label and number of draws in 16 bits; no row is drawn that often.
_LABEL, _DRAWS = 10, 1023
_PAD = np.uint16(0xFFFF)
#: Shares of rows that are drawn up to 0, 1, 2, ... times.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


@dataclass(frozen=True)
class Tree:
    """Nodes in order of their level. Cells up to ``cut`` of ``feature`` go to node ``left``, others to the
    one after it; a leaf has no ``left`` (-1) and counts with ``value``."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    KINDS = (np.int32, np.uint8, np.int32, np.float32)

    def packed(self) -> tuple[bytes, ...]:
        return tuple(a.astype(k).tobytes() for a, k in zip((self.feature, self.cut, self.left, self.value), self.KINDS))

    @classmethod
    def unpacked(cls, parts: tuple[bytes, ...]) -> Tree:
        return cls(*(np.frombuffer(p, k) for p, k in zip(parts, cls.KINDS)))


def cuts_of(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Up to ``bins`` - 1 cuts of weighted values, at their quantiles and halfway to the next value."""
    found, at = np.unique(values, return_inverse=True)
    if len(found) <= bins:
        last = np.arange(len(found) - 1)
    else:
        so_far = np.cumsum(np.bincount(at, weights))
        wanted = np.arange(1, bins) * (so_far[-1] / bins)
        last = np.unique(np.searchsorted(so_far, wanted - 1e-9 * so_far[-1]))
        last = last[last < len(found) - 1]
    return found[last] + (found[last + 1] - found[last]) / 2


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The matrix of bytes of a matrix of numbers."""
    out = np.empty(values.shape, np.uint8)
    for k, own in enumerate(cuts):
        out[:, k] = np.searchsorted(own, values[:, k], side="left")
    return out


def packed_cells(cells: np.ndarray) -> np.ndarray:
    """Three cells of five bits in each word of 16, for files and exchanges."""
    whole = np.zeros((len(cells), -(-cells.shape[1] // 3) * 3), np.uint16)
    whole[:, : cells.shape[1]] = cells
    return whole[:, 0::3] | whole[:, 1::3] << 5 | whole[:, 2::3] << 10


def unpacked_cells(words: np.ndarray, width: int) -> np.ndarray:
    whole = np.empty((len(words), words.shape[1] * 3), np.uint8)
    for k in range(3):
        whole[:, k::3] = words >> 5 * k & 31
    return np.ascontiguousarray(whole[:, :width])


def walk(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The value of each row's leaf."""
    node = np.zeros(len(bins), np.int32)
    rows = np.arange(len(bins))
    while len(rows):
        at = node[rows]
        inner = tree.left[at] >= 0
        rows, at = rows[inner], at[inner]
        node[rows] = tree.left[at] + (bins[rows, tree.feature[at]] > tree.cut[at])
    return tree.value[node]


def _drawn(rng: np.random.Generator, nodes: int, width: int, many: int) -> np.ndarray:
    """``many`` different features for each node."""
    if 4 * many > width:
        return np.argsort(rng.random((nodes, width), np.float32), axis=1)[:, :many].astype(np.int32)
    found = rng.integers(0, width, (nodes, many), np.int32)
    again = np.arange(nodes)
    while len(again):
        ordered = np.sort(found[again], axis=1)
        again = again[(ordered[:, 1:] == ordered[:, :-1]).any(axis=1)]
        found[again] = rng.integers(0, width, (len(again), many), np.int32)
    return found


def _spans(sizes: np.ndarray, most: int):
    """Runs of nodes that hold up to ``most`` rows together, or one node."""
    so_far = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(so_far, (so_far[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def _gini(l0, l1, t0, t1):
    """What a split leaves pure: larger is better; the whole node's figure is the bound to beat."""
    r0, r1 = t0 - l0, t1 - l1
    with np.errstate(divide="ignore", invalid="ignore"):
        return (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)


def _by_counts(bins, rows, draws, labels, starts, sizes, feats, weights, least):
    """Best (score, feature, cut) of nodes with many rows."""
    many = feats.shape[1]
    out = [], [], []
    for a, b in _spans(sizes, max(1, CELLS // many)):
        n = b - a
        hist = np.zeros(n * many * BINS * 2)
        for low in range(int(starts[a]), int(starts[b - 1] + sizes[b - 1]), max(1, CELLS // many)):
            high = min(low + max(1, CELLS // many), int(starts[b - 1] + sizes[b - 1]))
            some = rows[low:high]
            node = np.searchsorted(starts[a:b], np.arange(low, high), side="right") - 1
            cells = bins[some[:, None], feats[a:b][node]] if n > 1 else bins[some][:, feats[a]]
            code = ((node[:, None] * many + np.arange(many)) * BINS + cells) * 2 + labels[some][:, None]
            hist += np.bincount(code.ravel(), np.repeat(draws[some], many), len(hist))
        left = hist.reshape(n, many, BINS, 2).cumsum(axis=2)
        total = left[:, :, -1:, :]
        left = left[:, :, :-1, :]
        count = left.sum(3)
        score = _gini(left[..., 0] * weights[0], left[..., 1] * weights[1], total[..., 0] * weights[0], total[..., 1] * weights[1])
        score[(count < least) | (total.sum(3) - count < least) | np.isnan(score)] = -1
        score = score.reshape(n, -1)
        best = score.argmax(axis=1)
        out[0].append(score[np.arange(n), best])
        out[1].append(feats[a:b][np.arange(n), best // (BINS - 1)])
        out[2].append(best % (BINS - 1))
    return [np.concatenate(x) for x in out]


def _by_sorting(bins, rows, draws, labels, starts, sizes, feats, weights, least, length):
    """Best (score, feature, cut) of nodes with up to ``length`` rows."""
    many = feats.shape[1]
    w0, w1 = (np.float32(w) for w in weights)
    out = [], [], []
    step = max(1, CELLS // (many * length))
    for a in range(0, len(starts), step):
        own, size = starts[a : a + step], sizes[a : a + step]
        n = len(own)
        at = own[:, None] + np.minimum(np.arange(length), size[:, None] - 1)
        some = rows[at]
        rest = (labels[some].astype(np.uint16) << _LABEL) | draws[some]
        code = (bins[some[:, None, :], feats[a : a + n, :, None]].astype(np.uint16) << (_LABEL + 1)) | rest[:, None, :]
        code[np.broadcast_to((np.arange(length) >= size[:, None])[:, None, :], code.shape)] = _PAD
        code.sort(axis=2)
        count = np.where(code == _PAD, 0, code & _DRAWS).astype(np.float32)
        ones = count * ((code >> _LABEL) & 1)
        count, ones = count.cumsum(axis=2), ones.cumsum(axis=2)
        cell = code >> (_LABEL + 1)
        total, total1 = count[:, :, -1:], ones[:, :, -1:]
        count, ones = count[:, :, :-1], ones[:, :, :-1]
        score = _gini((count - ones) * w0, ones * w1, (total - total1) * w0, total1 * w1)
        score[(cell[:, :, 1:] == cell[:, :, :-1]) | (count < least) | (total - count < least) | np.isnan(score)] = -1
        score = score.reshape(n, -1)
        best = score.argmax(axis=1)
        slot, place = np.divmod(best, length - 1)
        every = np.arange(n)
        out[0].append(score[every, best])
        out[1].append(feats[a : a + n][every, slot])
        out[2].append(cell[every, slot, place])
    return [np.concatenate(x) for x in out]


def draws_of(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson numbers with mean 1 that follow from the rows' ids."""
    key = np.random.SeedSequence([seed, tree]).generate_state(1, np.uint64)[0]
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + key
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    share = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(_POISSON, share, side="right").astype(np.uint16)


def grow_classifier(
    bins: np.ndarray, labels: np.ndarray, draws: np.ndarray, weights: tuple[float, float], depth: int, many: int, rng: np.random.Generator, least: int = 2
) -> Tree:
    """A tree of a random forest: each row counts as often as it was drawn, ``many`` random features at each
    node, Gini impurity with class weights, ``least`` draws in each child. Values are the share of class 1.
    The order of the rows makes no difference."""
    rows = np.flatnonzero(draws).astype(np.int32)
    starts, sizes = np.zeros(1, np.int64), np.array([len(rows)])
    nodes: list[tuple] = []
    made, level = 1, 0
    while len(starts):
        held = draws[rows].astype(np.float64)
        filled = np.flatnonzero(sizes)
        count, ones = np.zeros(len(sizes)), np.zeros(len(sizes))
        if len(filled):
            count[filled] = np.add.reduceat(held, starts[filled])
            ones[filled] = np.add.reduceat(held * labels[rows], starts[filled])
        t0, t1 = (count - ones) * weights[0], ones * weights[1]
        value = np.divide(t1, t0 + t1, out=np.full(len(t1), 0.5), where=t0 + t1 > 0)
        feature, cut = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.uint8)
        left = np.full(len(sizes), -1, np.int32)
        open_ = np.flatnonzero((ones > 0) & (ones < count) & (count >= 2 * least)) if level < depth else filled[:0]
        if len(open_):
            score = np.full(len(open_), -1.0)
            feats = _drawn(rng, len(open_), bins.shape[1], many)
            args = lambda k: (bins, rows, draws, labels, starts[open_[k]], sizes[open_[k]], feats[k], weights, least)
            size = sizes[open_]
            # Nodes of many rows that stand side by side are read as one run, so single ones go alone.
            large = np.flatnonzero(size > SORTED)
            for run in np.split(large, np.flatnonzero((np.diff(open_[large]) > 1)) + 1) if len(large) else ():
                score[run], feature[open_[run]], cut[open_[run]] = _by_counts(*args(run))
            shortest = 1
            for length in (4, 8, 16, 32, SORTED):
                k = np.flatnonzero((size > shortest) & (size <= length))
                if len(k):
                    score[k], feature[open_[k]], cut[open_[k]] = _by_sorting(*args(k), length)
                shortest = length
            whole = ((t0 * t0 + t1 * t1) / np.maximum(t0 + t1, 1e-300))[open_]
            better = open_[score > whole * (1 + 1e-5)]
            left[better] = made + 2 * np.arange(len(better))
            made += 2 * len(better)
        else:
            better = open_
        nodes.append((feature, cut, left, value))
        # Rows of split nodes move on, those that go left first.
        keep = np.repeat(left >= 0, sizes)
        node = np.repeat(np.arange(len(better)), sizes[better])
        rows = rows[keep]
        goes = bins[rows, feature[better][node]] <= cut[better][node]
        own = sizes[better]
        begin = np.cumsum(own) - own
        before = np.cumsum(goes) - goes
        to_left = np.add.reduceat(goes.astype(np.int64), begin) if len(better) else own
        before -= np.repeat(before[begin] if len(better) else own, own)
        inside = np.arange(len(rows)) - np.repeat(begin, own)
        place = np.repeat(begin, own) + np.where(goes, before, np.repeat(to_left, own) + inside - before)
        moved = np.empty_like(rows)
        moved[place] = rows
        rows = moved
        sizes = np.stack([to_left, own - to_left], 1).reshape(-1)
        starts = np.cumsum(sizes) - sizes
        level += 1
    return Tree(*(np.concatenate(x) for x in zip(*nodes)))


def grow_regressor(
    bins: np.ndarray, target: np.ndarray, weights: np.ndarray, drawn: np.ndarray, depth: int, many: int, rng: np.random.Generator
) -> Tree:
    """A small tree that lowers the weighted variance of ``target`` over the ``drawn`` rows; ``many`` random
    features at each node, a drawn row in each child. Values are weighted means."""
    width = bins.shape[1]
    rows = np.flatnonzero(drawn)
    cells, y, w = bins[rows], target[rows], weights[rows]
    node = np.zeros(len(rows), np.int64)
    nodes: list[tuple] = []
    open_, made, level = 1, 1, 0
    while open_:
        total, sums = np.bincount(node, w, open_), np.bincount(node, w * y, open_)
        value = np.divide(sums, total, out=np.zeros(open_), where=total > 0)
        feature, cut, left = np.zeros(open_, np.int32), np.zeros(open_, np.uint8), np.full(open_, -1, np.int32)
        if level < depth:
            best = np.full(open_, -np.inf)
            allowed = np.zeros((open_, width), bool)
            np.put_along_axis(allowed, _drawn(rng, open_, width, many), True, axis=1)
            wy, low = w * y, node * BINS
            for f in range(width):
                code = low + cells[:, f]
                ws, wys, ns = (np.bincount(code, x, open_ * BINS).reshape(open_, BINS).cumsum(axis=1) for x in (w, wy, None))
                lw, ly, rw, ry = ws[:, :-1], wys[:, :-1], total[:, None] - ws[:, :-1], sums[:, None] - wys[:, :-1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = ly * ly / lw + ry * ry / rw
                score[(ns[:, :-1] < 1) | (ns[:, -1:] - ns[:, :-1] < 1) | ~np.isfinite(score) | ~allowed[:, f, None]] = -np.inf
                at = score.argmax(axis=1)
                mine = score[np.arange(open_), at]
                ahead = mine > best
                best[ahead], feature[ahead], cut[ahead] = mine[ahead], f, at[ahead]
            squares = np.bincount(node, w * y * y, open_)
            # What is left of a constant target after rounding is no variance.
            better = np.flatnonzero(best - sums * value > 1e-9 * np.maximum(squares, 1e-300))
            left[better] = made + 2 * np.arange(len(better))
            made += 2 * len(better)
            name = np.full(open_, -1)
            name[better] = np.arange(len(better))
            moves = name[node] >= 0
            cells, y, w, node = cells[moves], y[moves], w[moves], node[moves]
            right = cells[np.arange(len(node)), feature[node]] > cut[node]
            node = 2 * name[node] + right
            open_ = 2 * len(better)
        else:
            open_ = 0
        nodes.append((feature, cut, left, value))
        level += 1
    return Tree(*(np.concatenate(x) for x in zip(*nodes)))


def boost(
    bins: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int, step: float, depth: int, share: float, many: int, seed: int
) -> list[Tree]:
    """Trees of gradient boosting with the logistic loss 2 log(1 + exp(-2 y F)): the first fits the labels
    (-1 and 1), each of the rest the gradient over a share of the rows. Values are scaled by ``step``."""
    rng = np.random.default_rng(seed)
    y = 2.0 * labels - 1.0
    margin = np.zeros(len(y))
    trees = []
    for k in range(rounds):
        target = y if not k else 4.0 * y / (1.0 + np.exp(np.minimum(2.0 * y * margin, 700)))
        tree = grow_regressor(bins, target, weights, rng.random(len(y)) < share, depth, many, rng)
        tree = Tree(tree.feature, tree.cut, tree.left, (tree.value * (step if k else 1.0)).astype(np.float32))
        margin += walk(tree, bins)
        trees.append(tree)
    return trees
