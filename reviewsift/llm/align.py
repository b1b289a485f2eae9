"""Operator 12: alignment of the tokens of two tokenizers.

Method: the tokens of both sides cover the same bytes, so each side has cumulative ends. An
end-to-index dictionary of one side (a table addressed by byte offset) is met with the ends of the other;
the common ends, sorted, slice both id lists into groups. Inside a slice the links are expanded: between
two neighbouring ends of either side lies one token of each, and every overlapping pair owns
exactly one such stretch. Texts of a slice of rows stand behind each other in one byte range, as
their ends are common ends too.

How many documents hold an id pair linked comes from one pass over the written pairs: tasks
combine before the shuffle, so a pair that is in every document is a row per task. The most frequent pairs,
``HOT_PAIRS`` at most, go to every task; the others meet their counts in a join, where no key holds more
than a share of 1.2 / HOT_PAIRS of the rows.

The first side's library spends most of its time on offsets that nobody needs here. Where its
vocabulary is that of a file of ranks, texts of plain letters, signs, blanks and line ends are encoded by
ranks instead, which gives the same ids (a test compares them); all others go through the library.

Texts above ``LONG`` characters are encoded in parts that end at a blank between two letters, where
neither tokenizer has a token that crosses; a stretch without such a blank is encoded whole.

Edge cases: a null or empty text, and one that either side changes, has zeros and an empty digest;
any id passes through, null ids and repeated rows too, and each row counts as a document. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewsift.llm import common
from reviewsift.llm.bpe_fst import read_ranks
from reviewsift.session import materialize

A_FILE = "byte_bpe_50k.json"
A_RANKS = "byte_bpe_50k.tiktoken"
B_FILE = "piece_bpe_32k.model"
#: Most pairs whose counts are sent to every task.
HOT_PAIRS = 1 << 18
#: Characters above which a text is encoded in parts; characters of texts encoded together.
LONG = 1 << 17
#: Pairs that a task collects before it combines them.
_COMBINE = 1 << 22
#: Characters that both libraries split alike, in runs that are short enough for merging by ranks.
_PLAIN = "!-~À-ÖØ-öø-ſ"
_SAFE = re.compile(f"(?:[{_PLAIN}]{{1,256}}(?:[ \\n]+|$)|[ \\n]+)*+")
_CUT = re.compile("(?<=[A-Za-zÀ-ÖØ-öø-ɏΑ-Ρα-ωА-я]) (?=[A-Za-zÀ-ÖØ-öø-ɏΑ-Ρα-ωА-я])")


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(others)}


class Pair:
    """Both tokenizers, the bytes and lengths of their tokens and the texts of their ids."""

    def __init__(self, a_path: str, b_path: str, a_ranks: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        n_a, n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        entries = [self.a.id_to_token(i) or "" for i in range(n_a)]
        self.a_bytes = [bytes(letters[c] for c in e) if all(c in letters for c in e) else e.encode() for e in entries]
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
            for i in range(n_b)
        ]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        many = max(n_a, n_b)
        self.texts = {end: np.array([f"{i}{end}" for i in range(many)], object) for end in ",|;"}
        self.base = n_b
        ranks = read_ranks(a_ranks) if a_ranks else {}
        same = bool(ranks) and all(self.a_bytes[i] == token for token, i in ranks.items())
        self.by_rank = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if same else None
        #: Texts may be cut at a blank only if no piece has a blank behind another character.
        self.cuts = not any(b" " in x.lstrip(b" ") for x in self.b_bytes)

    def parts(self, text: str) -> list[str]:
        """Parts that give the text when joined by blanks."""
        if len(text) <= LONG or not self.cuts:
            return [text]
        found, at = [], 0
        while len(text) - at > LONG and (cut := _CUT.search(text, at + LONG)):
            found.append(text[at : cut.start()])
            at = cut.end()
        return [*found, text[at:]]

    def a_ids(self, text: str) -> list[int]:
        if self.by_rank and _SAFE.fullmatch(text):
            return self.by_rank.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> tuple[list[int], list[int]] | None:
        """Ids of both sides, or None if there are none or a side has other bytes."""
        if not text:
            return None
        a, b = [], []
        for part in self.parts(text):
            data = b" " + part.encode()
            ids_a = self.a_ids(" " + part)
            ids_b = self.b.encode(part, num_threads=1)
            if b"".join(map(self.a_bytes.__getitem__, ids_a)) != data or b"".join(map(self.b_bytes.__getitem__, ids_b)) != data:
                return None
            a += ids_a
            b += ids_b
        return a, b

    def align(self, sides: list[tuple[list[int], list[int]]]):
        """For texts behind each other: per text its groups, links and digest, and the links as pair codes
        with the number of their text."""
        a = np.concatenate([np.array(x, np.int64) for x, _ in sides])
        b = np.concatenate([np.array(x, np.int64) for _, x in sides])
        many_a, many_b = (np.array([len(side[k]) for side in sides]) for k in (0, 1))
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        index_b = np.full(int(ends_a[-1]) + 1, -1, np.int64)  # the end-to-index dictionary
        index_b[ends_b] = np.arange(len(b))
        met = index_b[ends_a]
        last_a = met >= 0
        last_b = np.zeros(len(b), bool)
        last_b[met[last_a]] = True
        group_a = np.cumsum(last_a) - last_a
        group_b = np.cumsum(last_b) - last_b
        stop_a, stop_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        start_b = np.concatenate([[0], stop_b[:-1]])
        # A group's ids stand after those of all groups before it, A's before B's.
        words = np.empty(len(a) + len(b), object)
        words[np.arange(len(a)) + start_b[group_a]] = np.where(last_a, self.texts["|"][a], self.texts[","][a])
        words[np.arange(len(b)) + stop_a[group_b]] = np.where(last_b, self.texts[";"][b], self.texts[","][b])
        # Every end of either side closes one stretch, and with it one link.
        is_a, is_b = np.zeros((2, int(ends_a[-1]) + 1), np.int32)
        is_a[ends_a] = is_b[ends_b] = 1
        stretch = np.flatnonzero(is_a | is_b)
        at_a, at_b = ((np.cumsum(side) - side)[stretch] for side in (is_a, is_b))
        codes = a[at_a] * self.base + b[at_b]
        upto_a, upto = np.cumsum(many_a), np.cumsum(many_a + many_b)
        closes = ends_a[upto_a - 1]
        links = np.diff(np.searchsorted(stretch, closes, "right"), prepend=0)
        groups = np.diff(np.searchsorted(stop_a, upto_a, "right"), prepend=0)
        digests = [hashlib.sha256("".join(words[s:e].tolist())[:-1].encode()).hexdigest() for s, e in zip(upto - many_a - many_b, upto)]
        return many_a, many_b, groups, links, digests, codes, np.repeat(np.arange(len(sides)), links)


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    values = np.sort(values)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[starts], np.diff(np.append(starts, len(values)))


_loaded: dict[tuple[str | None, ...], Pair] = {}


def _pair(*paths: str | None) -> Pair:
    if paths not in _loaded:
        _loaded[paths] = Pair(*paths)
    return _loaded[paths]


def _measured(docs: DataFrame, paths: tuple[str | None, ...]) -> DataFrame:
    """Counts and digest of each text, its distinct pairs (``codes``) and how often it links them (``times``)."""

    def work(pair: Pair, rows: pa.Array, ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        n = len(texts)
        sides = [pair.encode(t) for t in texts]
        have = [k for k, side in enumerate(sides) if side]
        numbers = np.zeros((4, n), np.int64)
        digests = [""] * n
        offsets = np.zeros(n + 1, np.int32)
        codes = times = np.zeros(0, np.int64)
        if have:
            *counts, found, linked, owner = pair.align([sides[k] for k in have])
            for row, values in zip(numbers, counts):
                row[have] = values
            for k, digest in zip(have, found):
                digests[k] = digest
            keys, times = _counted((owner << 32) | linked)
            codes = keys & 0xFFFFFFFF
            per_text = np.zeros(n, np.int32)
            per_text[have] = np.bincount(keys >> 32, minlength=len(have))
            offsets[1:] = np.cumsum(per_text)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.astype(np.int32))) for v in (codes, times)]
        return pa.RecordBatch.from_arrays([rows, ids, *map(pa.array, numbers), pa.array(digests), *lists], names=names)

    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*paths)
        for batch in batches:
            sizes = [len(x) if x else 0 for x in batch.column(2).to_pylist()]
            start = size = 0
            for stop, more in enumerate(sizes):
                if size and size + more > LONG:
                    cut = batch.slice(start, stop - start)
                    yield work(pair, cut.column(0), cut.column(1), cut.column(2).to_pylist())
                    start, size = stop, 0
                size += more
            if start < len(sizes):
                cut = batch.slice(start)
                yield work(pair, cut.column(0), cut.column(1), cut.column(2).to_pylist())

    counts = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(run, f"row bigint, doc_id {common.id_type(docs)}, {counts}, codes array<int>, times array<int>")


def pair_counts(measured: DataFrame, base: int) -> DataFrame:
    """(code, n, best): documents that hold each pair, and whether no pair of its A id is in more."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            codes, n = _counted(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(n.astype(np.int64))], names=["code", "n"])

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
            size += len(held[-1])
            if size > _COMBINE:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    counted = measured.select("codes").mapInArrow(combine, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    # An A id has as many pairs as the other side has ids, at most.
    of_a = Window.partitionBy(F.expr(f"code div {base}"))
    return counted.select("code", "n", (F.max("n").over(of_a) == F.col("n")).alias("best"))


def _hot(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, counts and best flags of the most frequent pairs, ``most`` at most, in order of codes."""
    step = F.floor(F.log2(F.col("n")) * 4).cast("int")
    levels = {r["step"]: r["pairs"] for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs")).collect()}
    least, total = None, 0
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > most:
            break
        least = level
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = counts.where(step >= least).select("code", "n", F.col("best").cast("int").alias("best")).toArrow()
    codes, n, best = (found.column(i).to_numpy().astype(np.int64) for i in range(3))
    order = np.argsort(codes)
    return codes[order], n[order], best[order]


def _looked_up(measured: DataFrame, counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(sums over the hot pairs of each row, occurrences of the other pairs)."""
    shared = measured.sparkSession.sparkContext.broadcast(_hot(counts, most))

    def spread(batch: pa.RecordBatch):
        """Pairs of a batch, how often, the place of their text, and where they stand among the hot ones."""
        codes, times = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (1, 2))
        lengths = np.diff(batch.column(1).offsets.to_numpy())
        owner = np.repeat(np.arange(batch.num_rows), lengths)
        hot = shared.value[0]
        at = np.searchsorted(hot, codes)
        known = np.zeros(len(codes), bool)
        inside = at < len(hot)
        known[inside] = hot[at[inside]] == codes[inside]
        return codes, times, owner, at, known

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, times, owner, at, known = spread(batch)
            _, n, best = shared.value
            out = []
            for values in (best, n):
                made = np.zeros(batch.num_rows, np.int64)
                np.add.at(made, owner[known], values[at[known]] * times[known])
                out.append(pa.array(made))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, *range(3, 9))), *out], names=[*shown, "hot_best", "hot_sum"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, times, owner, _, known = spread(batch)
            rows = batch.column(0).to_numpy()[owner[~known]]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(codes[~known].astype(np.int32)), pa.array(times[~known])], names=["row", "code", "times"])

    shown = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    types = ", ".join(f"{n} {t}" for n, t in measured.dtypes if n in shown)
    known = measured.select("row", "codes", "times", *shown[1:]).mapInArrow(sums, f"{types}, hot_best bigint, hot_sum bigint")
    return known, measured.select("row", "codes", "times").mapInArrow(rest, "row bigint, code int, times bigint")


def default_paths() -> tuple[str, str, str]:
    return public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE), public_tokenizers.path(A_RANKS)


def align(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str | None, ...] = (), hot_pairs: int = HOT_PAIRS
) -> DataFrame:
    """One row per input row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``paths`` names the files of both tokenizers and, if there is one, of the first one's ranks.
    """
    paths = paths or default_paths()
    measured = materialize(_measured(common.narrow(df, id_col, text_col), paths))
    counts = materialize(pair_counts(measured, _pair(*paths).base))
    known, rest = _looked_up(measured, counts, hot_pairs)
    others = (
        rest.join(counts, "code")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rest_best"), F.sum(F.col("n") * F.col("times")).alias("rest_sum"))
    )
    none = F.lit(0).cast("long")
    return known.join(others, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("hot_best") + F.coalesce("rest_best", none)).alias("n_best"),
        (F.col("hot_sum") + F.coalesce("rest_sum", none)).alias("count_sum"),
        "groups_sha256",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(common.table(spark, sf_dir, "documents"))
