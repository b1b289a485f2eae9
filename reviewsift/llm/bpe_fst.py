"""Merge rules as a lazily determinised transducer.

A prefix of a word has exactly one encoding, and its last token is the only token that ends the
prefix and fits the last token of what stands before it. Whether two tokens fit depends on the
two alone: their merge histories, replayed side by side, must never offer a merge across the
seam first. So the encodings of a word's prefixes can be followed from left to right.

A state keeps what may still matter: the longest suffix read that begins some token, and for
each suffix of it that begins a token the tokens chosen up to there. Tokens common to all those
choices are certain and leave the state as output: the lookahead is bounded by the longest
token. States are made when first reached and numbered; a transition holds the next state and
the tokens emitted.
"""

from __future__ import annotations

import base64
import json

NEVER = 1 << 60


class MergeRules:
    """Tokens as strings of symbols, and the rank of merging two neighbours."""

    def __init__(self, contents: dict[str, int], pair_ranks: dict[tuple[int, int], int] | None):
        """``pair_ranks`` None: any two tokens merge with the rank of the token they spell."""
        self.ids = contents
        self.contents = {i: s for s, i in contents.items()}
        self.pair_ranks = pair_ranks
        self._splits: dict[int, tuple[int, int, int] | None] = {}

    def rank(self, a: int, b: int) -> int:
        if self.pair_ranks is not None:
            return self.pair_ranks.get((a, b), NEVER)
        return self.ids.get(self.contents[a] + self.contents[b], NEVER)

    def split(self, token: int) -> tuple[int, int, int] | None:
        """The last merge that makes a token (left, right, rank); (-1, -1, -1) for one symbol;
        None if merging its symbols never gives it."""
        if token not in self._splits:
            parts = [self.ids[s] for s in self.contents[token]]
            if len(parts) == 1:
                self._splits[token] = (-1, -1, -1)
            else:
                last = None
                while len(parts) > 1:
                    rank, at = min((self.rank(parts[i], parts[i + 1]), i) for i in range(len(parts) - 1))
                    if rank == NEVER:
                        break
                    last = (parts[at], parts[at + 1], rank)
                    parts[at : at + 2] = [self.ids[self.contents[parts[at]] + self.contents[parts[at + 1]]]]
                self._splits[token] = last if parts == [token] else None
        return self._splits[token]

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """How the right (1) or left (0) end of a token grew: (token at the end, rank of its merge)."""
        grown = []
        while token >= 0:
            cut = self.split(token)
            grown.append((token, cut[2]))
            token = cut[side]
        return grown[::-1]


class Transducer:
    """Symbols in, tokens out. ``trans[state][symbol]`` is (next state, tokens emitted)."""


    def __init__(self, rules: MergeRules, states: int = 200_000):
        """``states`` bounds the states that are kept; memory is about a kilobyte for each."""
        self.rules = rules
        self.most_states, self.most_pairs = states, 5 * states // 2
        self.begins = {""}
        for s in rules.ids:
            self.begins.update(s[:k] for k in range(1, len(s)))
        self._ends: dict[int, list] = {}
        self._heads: dict[int, list] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._offsets: dict[str, tuple[int, ...]] = {}
        self._moves: dict[tuple[str, str], tuple] = {}
        self._reset()

    def _reset(self) -> None:
        self._number: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.trans: list[dict[str, tuple[int, tuple[int, ...]]]] = []
        self.final: list[tuple[int, ...]] = []
        self._state(("", None, ((),)))

    def _state(self, key: tuple) -> int:
        number = self._number.setdefault(key, len(self.keys))
        if number == len(self.keys):
            self.keys.append(key)
            self.trans.append({})
            self.final.append(key[2][-1])
        return number

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a and b, standing side by side, stay as they are."""
        known = self._fits.get((a, b))
        if known is None:
            if a not in self._ends:
                self._ends[a] = self.rules.edge(a, 1)
            if b not in self._heads:
                self._heads[b] = self.rules.edge(b, 0)
            left, right = self._ends[a], self._heads[b]
            i = j = 0
            known = True
            while True:
                across = self.rules.rank(left[i][0], right[j][0])
                grow_left = left[i + 1][1] if i + 1 < len(left) else NEVER
                grow_right = right[j + 1][1] if j + 1 < len(right) else NEVER
                if across < grow_left and across <= grow_right:
                    known = False
                    break
                if grow_left == grow_right == NEVER:
                    break
                if grow_left <= grow_right:
                    i += 1
                else:
                    j += 1
            if len(self._fits) > self.most_pairs:
                self._fits.clear()
            self._fits[(a, b)] = known
        return known

    def _starts(self, context: str) -> tuple[int, ...]:
        """Lengths of the suffixes of a context that begin a token, longest first; 0 is one."""
        if context not in self._offsets:
            n = len(context)
            self._offsets[context] = tuple(k for k in range(n, -1, -1) if context[n - k :] in self.begins)
        return self._offsets[context]

    def _move(self, context: str, symbol: str) -> tuple:
        """What a symbol does to a context, whatever was chosen: candidate tokens as (place among
        the starts, token), the next context, and where its starts stand among the old ones."""
        text = context + symbol
        n = len(text)
        found = []
        starts = self._starts(context)
        for k, start in enumerate(starts):
            token = self.rules.ids.get(text[n - 1 - start :])
            if token is not None and self.rules.split(token) is not None:
                found.append((k, token))
        while text not in self.begins:
            text = text[1:]
        kept = tuple(starts.index(start - 1) for start in self._starts(text) if start)
        if len(self._moves) > self.most_pairs:
            self._moves.clear()
        self._moves[(context, symbol)] = move = (found, text, kept)
        return move

    def step(self, state: int, symbol: str) -> tuple[int, tuple[int, ...]]:
        """Make the transition of a state for a symbol."""
        context, before, chosen = self.keys[state]
        found, text, kept = self._moves.get((context, symbol)) or self._move(context, symbol)
        known = self._fits
        newest = None
        for k, token in found:
            path = chosen[k]
            last = path[-1] if path else before
            if last is not None:
                fit = known.get((last, token))
                if fit is None:
                    fit = self.fits(last, token)
                if not fit:
                    continue
            newest = (*path, token)
            break
        if newest is None:
            raise ValueError(f"no token ends with symbol {symbol!r}")
        if not kept:  # no longer token can begin before here: all is certain
            made = (self._state(("", newest[-1], ((),))), newest)
        else:
            after = [chosen[k] for k in kept]
            sure, least = 0, min(len(newest), *map(len, after))
            while sure < least:
                token = newest[sure]
                for path in after:
                    if path[sure] != token:
                        break
                else:
                    sure += 1
                    continue
                break
            if sure:
                after = [path[sure:] for path in after]
            rest = (*after, newest[sure:])
            anchor = (newest[sure - 1] if sure else before) if () in rest else -1
            made = (self._state((text, anchor, rest)), newest[:sure])
        self.trans[state][symbol] = made
        return made

    def tokens(self, symbols: str) -> list[int]:
        if len(self.keys) > self.most_states:
            self._reset()
        state, out, trans = 0, [], self.trans
        for symbol in symbols:
            made = trans[state].get(symbol)
            if made is None:
                made = self.step(state, symbol)
            state = made[0]
            if made[1]:
                out += made[1]
        out += self.final[state]
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabularies of byte-level merges:
    printable Latin-1 bytes stand for themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def read_merges(path: str) -> tuple[MergeRules, str]:
    """Rules of a tokenizer file with byte-level merges and word ends, and its word-end mark.

    The last byte of a word is the symbol 256 + byte, all others are the byte itself.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    end = model["end_of_word_suffix"] or ""
    of = byte_symbols()

    def symbols(token: str) -> str | None:
        ends = bool(end) and token.endswith(end) and len(token) > len(end)
        body = token[: -len(end)] if ends else token
        if any(c not in of for c in body):
            return None
        coded = [chr(of[c]) for c in body]
        if ends:
            coded[-1] = chr(256 + ord(coded[-1]))
        return "".join(coded)

    contents = {s: i for token, i in model["vocab"].items() if (s := symbols(token))}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ranks: dict[tuple[int, int], int] = {}
    for rank, (a, b) in enumerate(merges):
        left, right = contents.get(symbols(a) or ""), contents.get(symbols(b) or "")
        if left is not None and right is not None:
            ranks[(left, right)] = rank
    return MergeRules(contents, ranks), end
