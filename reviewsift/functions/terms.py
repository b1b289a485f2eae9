"""Matching many terms and pattern families in few passes over a text.

A rubric looks for a few hundred terms in every review. The terms stand in an index by their rarest
letter; the letters of a text are met with the index once, and only terms whose letter is there
get the exact test, a native substring search. The result is a short array of the terms found,
and every list of the rubric is then an array expression over it. Lists that only ask whether
*any* term occurs need just their shortest terms: one that contains another of the list decides
nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reviewsift.functions.columns import matches


def _key(term: str) -> str | None:
    """The letter by which a term is indexed: the rarest one by script block, NULL if all are ASCII.

    Letters with two marks stand in higher blocks than those with one, which other languages
    share; of a block, the letter that is last in the order of code points is taken.
    """
    letters = [c for c in term if ord(c) > 0x7F]
    return max(letters, key=lambda c: (ord(c) >= 0x1E00, ord(c) >= 0x100, ord(c))) if letters else None


def term_index(terms: Iterable[str]) -> dict[str | None, list[str]]:
    """The distinct terms by their key; those without one stand under None and are always tested."""
    index: dict[str | None, list[str]] = {}
    for term in dict.fromkeys(t for t in terms if t):
        index.setdefault(_key(term), []).append(term)
    return index


def with_found_terms(df: DataFrame, text: str, terms: Iterable[str], output: str) -> DataFrame:
    """Add the distinct terms that occur in a text column as substrings (NULL for NULL)."""
    index = term_index(terms)
    keys = sorted(k for k in index if k is not None)
    source = F.col(text)

    def tested(some: Sequence[str]) -> Column:
        return F.array_compact(F.array(*[F.when(source.contains(t), F.lit(t)) for t in some]))

    # What is not ASCII is short; a step of its own, so that it is computed once for all keys.
    df = df.withColumn("_letters", F.regexp_replace(source, r"[\x00-\x7f]+", ""))
    parts = [F.when(F.col("_letters").contains(k), tested(index[k])) for k in keys]
    if None in index:
        parts.append(tested(index[None]))
    found = F.flatten(F.array_compact(F.array(*parts))) if parts else F.array().cast("array<string>")
    return df.withColumn(output, F.when(source.isNotNull(), found)).drop("_letters")


def decisive(terms: Sequence[str]) -> tuple[str, ...]:
    """The terms of a list that contain no other of its terms: a text holds one of these exactly
    if it holds one of the list."""
    distinct = tuple(dict.fromkeys(t for t in terms if t))
    return tuple(t for t in distinct if not any(o != t and o in t for o in distinct))


def literal_array(terms: Sequence[str]) -> Column:
    """A constant array, as one SQL literal: a list may hold hundreds of terms."""
    quoted = ["'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in terms]
    return F.expr(f"cast(array({', '.join(quoted)}) as array<string>)")


def has_any(found: Column, terms: Sequence[str]) -> Column:
    """Whether one of the terms occurs; ``found`` holds at least the :func:`decisive` ones."""
    shortest = decisive(terms)
    return F.arrays_overlap(literal_array(shortest), found) if shortest else F.lit(False)


def hits(found: Column, terms: Sequence[str]) -> Column:
    """The found ones of a list, in list order."""
    return F.array_intersect(literal_array(terms), found)


# A pattern that starts with a group of plain alternatives: one of them has to occur.
_PLAIN = r"[^()|\\.\[\]{}?*+^$]+"
_LEADING_GROUP = re.compile(rf"^\(({_PLAIN}(?:\|{_PLAIN})*)\)(.*)$", re.DOTALL)


def _cut(pattern: str) -> tuple[list[str], int]:
    """The branches between the ``|`` outside all groups and classes, and where the first group ends
    (0 if none does)."""
    depth, at, in_class, start, closed = 0, 0, False, 0, 0
    branches = []
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif in_class:
            in_class = c != "]" or pattern[at - 1] == "[" or pattern[at - 2 : at] == "[^"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
            closed = closed or (at if depth == 0 else 0)
        elif c == "|" and depth == 0:
            branches.append(pattern[start:at])
            start = at + 1
        at += 1
    return [*branches, pattern[start:]], closed


def _branches(rest: str) -> bool:
    """Whether a ``|`` stands outside all groups and classes, so that the start of the pattern
    is only one of its branches."""
    return len(_cut(rest)[0]) > 1


def first_terms(pattern: str) -> tuple[str, ...]:
    """Plain starts of which every match has one; none if a branch starts otherwise."""
    branches, closed = _cut(pattern)
    if len(branches) > 1:
        starts = [first_terms(branch) for branch in branches]
        return tuple(t for some in starts for t in some) if all(starts) else ()
    if pattern[:1] == "(":
        plain = closed and pattern[1:2] != "?" and pattern[closed + 1 : closed + 2] not in ("?", "*", "{")
        return first_terms(pattern[1:closed]) if plain else ()
    start = re.match(_PLAIN, pattern)
    if not start:
        return ()
    # The last character may be left out if a quantifier follows.
    term = start.group()[:-1] if pattern[start.end() : start.end() + 1] in ("?", "*", "{") else start.group()
    return (term,) if term else ()


def leading_terms(pattern: str) -> tuple[tuple[str, ...], bool]:
    """(alternatives a pattern has to start with, whether they are the whole pattern)."""
    match = _LEADING_GROUP.match(pattern)
    if not match or match.group(2)[:1] in ("?", "*", "{") or _branches(match.group(2)):
        return (), False
    return tuple(match.group(1).split("|")), match.group(2) == ""


def pattern_terms(patterns: Iterable[str]) -> list[str]:
    """Every term that decides or gates one of the patterns."""
    return [term for p in patterns for term in decisive(leading_terms(p)[0] or first_terms(p))]


def occurs(text: Column, found: Column, pattern: str) -> Column:
    """Whether a pattern occurs; ``found`` holds the terms of :func:`pattern_terms`.

    The regex runs only on texts that hold one of its leading alternatives or plain starts.
    """
    terms, whole = leading_terms(pattern)
    terms = terms or first_terms(pattern)
    if not terms:
        return matches(text, pattern)
    present = has_any(found, terms)
    return present if whole else present & matches(text, pattern)


def occurrences(text: Column, found: Column, patterns: Iterable[str]) -> Column:
    """How many patterns of a family occur."""
    total: Column = F.lit(0)
    for pattern in patterns:
        total = total + occurs(text, found, pattern).cast("int")
    return total
