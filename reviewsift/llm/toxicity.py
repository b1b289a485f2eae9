"""Operator 2: toxicity scores.

Method: a lexicon of offensive words and stems is a trie. Intersected with Levenshtein automata
(one error, two for terms of eight letters or more) it becomes one deterministic automaton, made
state by state when first needed, that tells for a word which term it spells or misspells. Hits
are then weighed in their context window: quotation marks around a hit, words of reporting
and distance from an address to the reader separate quotation from abuse. A logistic model over these
few features gives the score.

The lexicon is a short fixed list plus what labelled rows teach; words and model are learned from a
bounded sample of them in the order of a hash of the id: ``sample`` rows of each label. Everything
else reads all rows whole.

Edge cases: null and empty texts have no hits and get the model's score for that (low). Rows
with a null id are scored and never learned from. Without toxic or without clean rows to learn
from, the fixed list alone is used, with a fixed rule for the score.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewsift.llm import common
from reviewsift.session import materialize

#: Rows of each label that lexicon and model are learned from, at most.
SAMPLE = 4_000
THRESHOLD = 0.3
#: Letters of a stem at least; toxic documents a term must be in at least; share of its documents
#: (each label weighted to one half) that must be toxic.
STEM, LEAST_DOCS, PURE = 4, 3, 0.95
MOST_TERMS = 2_000
WINDOW = 8
#: Words and automaton states that a worker keeps at most.
MOST_WORDS = 50_000
MOST_STATES = 20_000

#: Terms that need no example: plain English insults, a fixed list.
SEEDS = (
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile fool loser losers pathetic worthless "
    "scum scumbag trash garbage filth filthy vermin parasite disgusting disgrace clown coward liar freak creep "
    "jerk bastard bitch asshole shit bullshit fuck fucking whore slut retard retarded cretin degenerate pig swine"
).split()

_TOKEN = regex.compile(r"\p{L}+|[\"“”„«»‘’]")
_QUOTES = frozenset("\"“”„«»‘’")
#: Words of reporting and of address in the four languages of the tables: fixed lists.
REPORTING = frozenset("said says wrote quoted quote called reported dit écrit cité dijo escribió citó sagte schrieb zitierte".split())
ADDRESS = frozenset("you your youre u tu toi vous votre usted tú du dich ihr dein".split())
#: Weights of the features and intercept while there is nothing to learn from.
UNTAUGHT = (3.0, 1.5, 0.5, 0.5, 0.5, -3.0)
FEATURES = ("exact", "misspelled", "quoted", "addressed", "dense")


class TermAutomaton:
    """Words to (term, errors). A term ending in ``*`` is a stem: anything may follow it."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.allowed: list[int] = [0]
        for number, term in enumerate(terms):
            node, body = 0, term.rstrip("*")
            most = 2 if len(body) >= 8 else 1
            self.allowed[0] = max(self.allowed[0], most)
            for letter in body:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.allowed.append(0)
                node = self.children[node][letter]
                self.allowed[node] = max(self.allowed[node], most)
            self.ends[node].append(number)
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.trans: list[dict[str, int]] = []
        self.result: list[tuple[int, int] | None] = []
        self.start = self._state(self._closed({0: 0}), None)
        self.dead = self._state({}, None)

    def _closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """Adds nodes reached by leaving out letters of the term."""
        todo = list(nodes.items())
        while todo:
            node, errors = todo.pop()
            for child in self.children[node].values():
                if errors + 1 <= self.allowed[child] and nodes.get(child, 9) > errors + 1:
                    nodes[child] = errors + 1
                    todo.append((child, errors + 1))
        return nodes

    def _most(self, number: int) -> int:
        return 2 if len(self.terms[number].rstrip("*")) >= 8 else 1

    def _state(self, nodes: dict[int, int], stem: tuple[int, int] | None) -> int:
        """Number of a state: trie nodes with their least errors, and the best stem passed."""
        best = stem
        for node, errors in nodes.items():
            for number in self.ends[node]:
                if errors <= self._most(number):
                    if self.terms[number].endswith("*") and (stem is None or errors < stem[0]):
                        stem = (errors, number)
                    if best is None or (errors, number) < best:
                        best = (errors, number)
        key = (frozenset(nodes.items()), stem)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append((nodes, stem))
            self.trans.append({})
            self.result.append(best)
        return self.numbers[key]

    def step(self, state: int, letter: str) -> int:
        nodes, stem = self.states[state]
        after: dict[int, int] = {}
        for node, errors in nodes.items():
            for symbol, child in self.children[node].items():
                cost = errors + (symbol != letter)
                if cost <= self.allowed[child] and after.get(child, 9) > cost:
                    after[child] = cost
            if errors + 1 <= self.allowed[node] and after.get(node, 9) > errors + 1:
                after[node] = errors + 1  # a letter too many
        made = self._state(self._closed(after), stem)
        self.trans[state][letter] = made
        return made

    def find(self, word: str) -> tuple[int, int] | None:
        """(errors, term number) of the best term, or None."""
        if len(self.states) > MOST_STATES:
            self._reset()
        state, trans, dead = self.start, self.trans, self.dead
        for letter in word:
            after = trans[state].get(letter)
            if after is None:
                after = self.step(state, letter)
            state = after
            if state == dead:
                return None
        return self.result[state]


class Scanner:
    """Features of a text."""

    def __init__(self, terms: list[str]):
        self.automaton = TermAutomaton(terms) if terms else None
        self.memo: dict[str, tuple[int, int] | None] = {}

    def hit(self, word: str) -> tuple[int, int] | None:
        if len(self.memo) >= MOST_WORDS:
            self.memo.clear()
        found = self.automaton.find(word)
        if len(word) <= 40:
            self.memo[word] = found
        return found

    def features(self, text: str | None) -> list[float]:
        counts = [0.0] * len(FEATURES)
        if not text or self.automaton is None:
            return counts
        words = _TOKEN.findall(text.lower())
        memo, missing = self.memo, ()
        hits = []
        for at, word in enumerate(words):
            found = memo.get(word, missing)
            if found is missing:
                found = self.hit(word)
            if found is not None:
                hits.append((at, found[0]))
        last = -10 * WINDOW
        for at, errors in hits:
            before, after = words[max(0, at - WINDOW) : at], words[at + 1 : at + 1 + WINDOW]
            marks = any(w in _QUOTES for w in before) and any(w in _QUOTES for w in after)
            quoted = marks or any(w in REPORTING for w in before)
            counts[2 if quoted else (1 if errors else 0)] += 1
            counts[3] += any(w in ADDRESS for w in before + after)
            counts[4] += at - last <= WINDOW
            last = at
        return [float(np.log1p(c)) for c in counts]


_scanners: dict[str, Scanner] = {}


def scanner_of(terms: list[str]) -> Scanner:
    """One scanner per lexicon and Python worker."""
    name = json.dumps(terms)
    if name not in _scanners:
        _scanners[name] = Scanner(terms)
    return _scanners[name]


def held_out(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, toxic): at most ``sample`` rows of each label, never held-out ones."""
    named = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").dropDuplicates(["doc_id"])
    named = named.where(~held_out(F.col("doc_id")))
    chosen = [named.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    return docs.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").select("doc_id", "text", "toxic")


def learn_terms(rows: DataFrame) -> list[str]:
    """Words and stems that are nearly only in toxic texts.

    A stem is as long as it can be without losing documents. Where one word makes up nearly all
    of a stem, the word is the term. A term must be in so many toxic texts that chance would not put
    even one of the vocabulary's terms into as many toxic texts and no others.
    """
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return sorted(SEEDS)
    words = rows.select("doc_id", "toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("word")).where(F.length("word") >= STEM)
    ends = F.concat(
        F.array(F.concat("word", F.lit("."))), F.transform(F.sequence(F.lit(STEM), F.least(F.length("word"), F.lit(12))), lambda k: F.substring("word", F.lit(1), k))
    )
    terms = words.select("doc_id", "toxic", F.explode(ends).alias("term")).distinct()
    counts = terms.groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    vocabulary = max(2, counts.count())
    chance = totals[1] / (totals[0] + totals[1])
    least = max(LEAST_DOCS, int(np.ceil(np.log(vocabulary) / -np.log(chance))))
    pure = counts.where((F.col("a") >= least) & (F.col("a") / totals[1] >= PURE * (F.col("a") / totals[1] + (F.col("n") - F.col("a")) / totals[0])))
    found = {r["term"]: (r["a"], r["n"] - r["a"]) for r in pure.orderBy(F.desc("a"), "term").limit(20 * MOST_TERMS).collect()}
    kept: list[str] = []
    covered: set[str] = set()
    for term in sorted(found, key=lambda t: (len(t.rstrip(".")), t)):
        body = term.rstrip(".")
        if any(body[:k] in covered for k in range(STEM, len(body) + 1)):
            continue
        # Lengthen the stem as long as one continuation keeps nearly all of its documents.
        while longer := [t for t in found if len(t) == len(body) + 1 and t.startswith(body) and not t.endswith(".") and found[t][0] >= 0.9 * found.get(body, found[term])[0]]:
            body = longer[0]
        covered.add(term.rstrip("."))
        covered.add(body)
        whole = found.get(body + ".")
        alone = whole is not None and whole[0] >= 0.9 * found.get(body, whole)[0]
        kept.append((found.get(body, found[term])[0], body if alone or body not in found else body + "*"))
    learned = [term for _, term in sorted(kept, reverse=True)[:MOST_TERMS]]
    return learned + sorted(set(SEEDS) - set(learned))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept. Weights have
    no bound, so a kind of hit that is rare in the sample may come out below zero."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> str:
    """Terms and weights as JSON; a few kilobytes, whatever the input."""
    rows = materialize(training_rows(docs, labels, sample))
    terms = learn_terms(rows)
    features = scored_features(rows, terms, keep="toxic")
    collected = features.collect()  # at most two samples of five numbers
    y = np.array([r["toxic"] for r in collected], float)
    if len(set(y.tolist())) < 2:
        return json.dumps({"terms": terms, "weights": list(UNTAUGHT[:-1]), "bias": UNTAUGHT[-1]})
    weights = fit(np.array([r["features"] for r in collected]), y)
    return json.dumps({"terms": terms, "weights": weights[:-1].tolist(), "bias": float(weights[-1])})


def scored_features(rows: DataFrame, terms: list[str], keep: str) -> DataFrame:
    def run(batches):
        scanner = scanner_of(terms)
        for batch in common.slices(batches):
            found = [scanner.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=[keep, "features"])

    return rows.select(keep, "text").mapInArrow(run, f"{keep} int, features array<double>")


def scores(model: str, texts: list[str | None]) -> np.ndarray:
    made = json.loads(model)
    scanner = scanner_of(made["terms"])
    found = np.array([scanner.features(t) for t in texts])
    return 1 / (1 + np.exp(-np.clip(found @ np.array(made["weights"]) + made["bias"], -30, 30)))


def drop_toxic(df: DataFrame, model: str, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of a table, all columns, whose score is below the threshold."""
    return common.keep_rows(df, lambda texts: scores(model, texts) < threshold, text_col)


def score(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``."""
    source = common.narrow(df, id_col, text_col)

    def work(texts):
        return [scores(model, texts)]

    scored = common.map_texts(source, work, f"doc_id {common.id_type(source)}, score double", ["score"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def model_for(spark: SparkSession, sf_dir: str) -> str:
    """The model of a folder's documents and labels."""
    return learn(common.narrow(common.table(spark, sf_dir, "documents"), "doc_id", "text"), common.table(spark, sf_dir, "labels"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), model_for(spark, sf_dir))
