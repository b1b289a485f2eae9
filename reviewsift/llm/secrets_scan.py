"""Operator 9: secrets in source, configuration and prose.

Method: assignment-aware lexing. Texts that hold an assignment mark are lexed into pairs of a
name and its value (quoted literals, bare words, concatenations, and references to other names).
Constants propagate: a reference takes over the literals of the name it points to, through any
number of steps. Each literal is scored by how sensitive the names are that it reaches and by how
random it looks; what passes is added as spans of kind ``lexed``: literals that are not too plain
under a strong name, and literals that look random under any listed name. The three base
patterns (kinds ``assign``, ``access``, ``hex``) are found as the contract defines them and always
stay.

Edge cases: a null text counts as empty: no spans, the digest of nothing. Any id passes through.
Names are lexed in order, so a name that is set twice refers to its latest literal above;
``$`` references without one above take the first below.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewsift.llm import common

#: The base patterns, with the least lengths of what they must catch.
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
#: What a text must hold, in lower case, for the first pattern to match.
STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "lexed")

#: Weights of words inside target names.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "private": 0.6, "key": 0.5, "auth": 0.5, "bearer": 0.7,
    "signature": 0.4, "salt": 0.5, "dsn": 0.5, "pin": 0.6,
}
THRESHOLD = 0.6
#: Under a weak name a literal must look random: name and literal together must be this certain.
CERTAIN, LEAST_CHANCE = 0.76, 0.45
LEAST_LITERAL = 8
#: Names whose quoted literals may hold blanks.
PHRASES = {"password", "passwd", "passphrase", "pwd", "pass"}

_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
#: A pair begins at a quote or at the first character that a name can have, and a name gives nothing
#: back: a long run of such characters is read once.
_PAIR = re.compile(rf"""(?:(?=["'])|(?<![A-Za-z0-9_.\-])[0-9.\-]*+)(?P<q>["']?)(?P<name>{_NAME})(?P=q)[ \t]*(?::=|=>|=(?!=)|:(?![:/]))[ \t]*(?=\S)""", re.ASCII)
_VALUE = re.compile(rf"""(?P<quote>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<ref>\$\{{?{_NAME}\}}?)|(?P<bare>[A-Za-z0-9+/_.=\-]+)""", re.ASCII)
_PLUS = re.compile(r"[ \t]*\+[ \t]*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_WORD = re.compile(r"[A-Z]?[a-z]{4,}|[A-Z][a-z]{3}|[A-Z]{4,}(?![a-z])|(?<![A-Za-z0-9+/])[A-Za-z]{2,3}(?![A-Za-z0-9+/])")
_LOGIN = re.compile(r"://[^/\s:@]*:([^/\s@]+)@")
_HARD = re.compile(r"(?i:[b-df-hj-np-tv-xz]{5}|^[b-df-hj-np-tv-xz]+$)")
_MARKS = re.compile(r"[ _.:,-]")
_ALPHABETS = [(re.compile(p), size) for p, size in (("[0-9]+", 10), ("[0-9a-f]+|[0-9A-F]+", 16), ("[a-z]+|[A-Z]+", 26), ("[0-9a-z]+|[0-9A-Z]+", 36))]


def base_spans(text: str, lower: str) -> list[tuple[int, int, str]]:
    spans = []
    if any(stem in lower for stem in STEMS):
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def name_words(name: str) -> list[str]:
    """The words of a target name, joined neighbours included."""
    words = [w.lower() for w in _PARTS.findall(name)]
    return words + [a + b for a, b in zip(words, words[1:])]


def name_weight(name: str) -> float:
    """How sensitive a target name is: of its words the strongest."""
    return max((SENSITIVE.get(w, 0.0) for w in name_words(name)), default=0.0)


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def literal_weight(value: str) -> float:
    """How little plain a literal is, from 0 to 1: its entropy against the most its length allows,
    less for plain words, more for mixed character classes."""
    n = len(value)
    if n < LEAST_LITERAL:
        return 0.0
    entropy = _entropy(value) / math.log2(min(n, 64))
    classes = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + (not value.isalnum())
    return min(1.0, entropy * (0.55 if classes < 2 else 0.85 + 0.1 * (classes - 2)))


@functools.cache
def _random_entropy(n: int, size: int) -> float:
    """The entropy to expect of ``n`` random letters of ``size``."""
    p = 1 / size
    chances = ((math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p), k) for k in range(1, n + 1))
    return -size * sum(math.exp(c) * k / n * math.log2(k / n) for c, k in chances)


def chance(value: str) -> float:
    """How much a literal looks drawn at random, from 0 to 1, at any length: the share of it that is
    neither words nor marks between them, less if its entropy is below that of a random string of
    its alphabet. Digits alone count about half, since they may be plain numbers; of an address with
    a login its password counts."""
    if login := _LOGIN.search(value):
        value = login[1]
    packed = _MARKS.sub("", value)
    if len(packed) < LEAST_LITERAL:
        return 0.0
    worded = sum(len(w) for w in _WORD.findall(value) if not _HARD.search(w))
    size = next((size for shape, size in _ALPHABETS if shape.fullmatch(packed)), 64)
    usual = _random_entropy(min(len(packed), 256), size)
    return min(1.0, _entropy(packed) / usual) * (len(packed) - worded) / len(value) * (0.5 if packed.isdigit() else 1.0)


def is_secret(name: str, value: str) -> bool:
    """Whether a literal that reaches a name is reported: every listed name can pass with a random one."""
    weight = name_weight(name)
    if weight == 0 or len(value) < LEAST_LITERAL or (" " in value and PHRASES.isdisjoint(name_words(name))):
        return False
    plain = literal_weight(value)
    if plain > 0 and weight * (0.4 + 0.6 * plain) >= THRESHOLD:
        return True
    random = chance(value)
    return random >= LEAST_CHANCE and 1 - (1 - weight) * (1 - random) >= CERTAIN


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name, as spans of the literal without its quotes."""
    # Of each pair its name, its own literals, the pairs it refers to, and whether it is one value.
    pairs: list[tuple[str, list[tuple[int, int]], list[str], bool]] = []
    for pair in _PAIR.finditer(text):
        at, literals, names, direct = pair.end(), [], [], True
        while value := _VALUE.match(text, at):
            start, end = value.span()
            if value["quote"]:
                literals.append((start + 1, end - 1))
            elif value["ref"]:
                names.append(value["ref"].strip("${}"))
            else:
                literals.append((start, end))
            plus = _PLUS.match(text, end)
            if not plus:
                break
            at, direct = plus.end(), False
        pairs.append((pair["name"], literals, names, direct))
    places: dict[str, list[int]] = {}
    for k, (name, *_) in enumerate(pairs):
        places.setdefault(name, []).append(k)

    def target(name: str, k: int, above: bool = False) -> int | None:
        """The pair a name refers to in pair k: the latest above, else the first below."""
        where = places.get(name)
        if not where:
            return None
        n = bisect.bisect_left(where, k)
        later = where[n:] if where[n:] and where[n] != k else where[n + 1 :]
        return where[n - 1] if n else later[0] if later and not above else None

    found: set[tuple[int, int]] = set()
    for k, (name, _, _, direct) in enumerate(pairs):
        if name_weight(name) == 0:
            continue
        reached, todo, visited = {}, [k], {k}
        while todo:
            here = todo.pop()
            _, literals, names, _ = pairs[here]
            nexts = [target(n, here) for n in names]
            for a, b in literals:
                # A bare word is a reference if its name is set above.
                aim = target(text[a:b], here, above=True) if text[a - 1 : a] not in ('"', "'") else None
                if aim is None:
                    reached[(a, b)] = None
                nexts.append(aim)
            for aim in nexts:
                if aim is not None and aim not in visited:
                    visited.add(aim)
                    todo.append(aim)
        spans = sorted(reached)
        whole = "".join(text[a:b] for a, b in spans)
        found.update(span for span in spans if is_secret(name, text[slice(*span)] if direct else whole))
    return [(a, b, "lexed") for a, b in found]


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and those together with the spans that lexing adds."""
    base = base_spans(text, text.lower())
    if "=" not in text and ":" not in text:
        return base, base
    return base, sorted(base + lexed_spans(text), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id`` and ``found``, an array of (kind, start, end, base)."""
    source = common.narrow(df, id_col, text_col)

    def work(texts):
        rows = []
        for text in texts:
            base, every = all_spans(text or "")
            own = set(base)
            rows.append([{"kind": k, "start": a, "end": b, "base": (a, b, k) in own} for a, b, k in every])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        return [pa.array(rows, kind)]

    return common.map_texts(source, work, f"doc_id {common.id_type(source)}, found array<struct<kind:string,start:int,end:int,base:boolean>>", ["found"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["base"])
    number = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(number(kind) for kind in KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans")
    )
