"""Operator 6: token counts of texts.

Method: a deterministic transducer (``bpe_fst``, lazily compiled) run over chunks of the texts. Its
transitions hold emitted ids; the count is the length of the list. White space always brings it
back to its initial state, so a chunk is known by what it reads before its first white space
(``head``), the count after it, and what it has read since its last white space (``tail``). Chunks of
a long text are counted in separate tasks; one task puts a text's chunks together in order and
tokenises the seams, a tail with the next head, again.

A null text counts as empty: 0 bytes, 0 tokens. Rows with equal or null ids are counted row by
row. Special strings inside texts count one token each, as the library does by default.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewsift.llm import common
from reviewsift.llm.bpe_fst import Transducer, read_merges

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Code points of a chunk; longer texts are counted in several tasks.
CHUNK = 1 << 16
MOST_WORDS = 150_000

#: Fixed values of the tokenizer file: its special strings and its word pattern.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
_SPACE = regex.compile(r"\p{White_Space}+")


class Counter:
    """Counts by the transducer, with the counts of frequent words kept."""

    def __init__(self, path: str):
        rules, _ = read_merges(path)
        self.machine = Transducer(rules)
        self.find = regex.compile(WORDS).findall
        self.special = regex.compile("|".join(map(regex.escape, SPECIAL)))
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def word(self, word: str) -> int:
        if (made := self.older.get(word)) is not None:
            self.memo[word] = made
            return made
        symbols = word.encode("utf-8").decode("latin-1")
        made = len(self.machine.tokens(symbols[:-1] + chr(256 + ord(symbols[-1]))))
        if len(word) <= 64 and len(self.memo) < 2 * MOST_WORDS:
            self.memo[word] = made
        return made

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text.isascii():
            # Lower-casing is by character here: a capital sigma never becomes a final one.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if len(self.memo) >= MOST_WORDS:
            self.older, self.memo = self.memo, {}
        known, word, total = self.memo.get, self.word, 0
        for piece in self.find(text.lower()):
            total += known(piece) or word(piece)
        return total

    def count(self, text: str) -> int:
        if "<|" not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))

    def chunk_map(self, text: str) -> tuple[str, int, str] | tuple[str, None, None]:
        """(head, tokens between, tail); without white space all is head and there is no exit."""
        first = _SPACE.search(text)
        if not first:
            return text, None, None
        last = len(text)
        while not text[last - 1].isspace() or not _SPACE.match(text[last - 1]):
            last -= 1
        return text[: first.start()], self.count(text[first.start() : last]), text[last:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring chunks from the maps of each."""
        if a[1] is None:
            return (a[0] + b[0], b[1], b[2])
        if b[1] is None:
            return (a[0], a[1], a[2] + b[0])
        return (a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2])

    def scan(self, maps: list[tuple]) -> int:
        """Tokens of the chunks together: compose neighbours until one map is left."""
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        head, between, tail = maps[0]
        return self.count(head) + (0 if between is None else between + self.count(tail))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter per Python worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK
) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens).

    Texts of up to ``chunk`` code points are counted where they are read. Longer ones are cut
    into chunks that are spread over the cluster; only their maps meet again.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    source = common.narrow(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    kind = common.id_type(source)
    short = source.where(F.length("text") <= chunk)
    long = source.where(F.length("text") > chunk)

    def whole(texts: list[str]) -> list[list]:
        count = counter(path).count
        return [[len(t.encode("utf-8")) for t in texts], [count(t) for t in texts]]

    counted = common.map_texts(short, whole, f"doc_id {kind}, n_bytes bigint, n_tokens bigint", ["n_bytes", "n_tokens"])

    pieces = (
        long.withColumn("row", F.expr("uuid()"))
        .select("doc_id", "row", "text", F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / chunk).cast("int") - 1)).alias("k"))
        .select("doc_id", "row", "k", F.substring("text", F.col("k") * chunk + 1, F.lit(chunk)).alias("piece"))
        .repartition(common.partitions(df), "row", "k")
    )

    def mapped(batches):
        of = counter(path)
        for batch in common.slices(batches, 64):
            maps = [of.chunk_map(t) for t in batch.column(3).to_pylist()]
            sizes = [len(t.encode("utf-8")) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), *(pa.array([m[i] for m in maps], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string())))],
                names=["doc_id", "row", "k", "n_bytes", "head", "between", "tail"],
            )

    maps = pieces.mapInArrow(mapped, f"doc_id {kind}, row string, k int, n_bytes bigint, head string, between bigint, tail string")
    joined = maps.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.sum("n_bytes").alias("n_bytes"),
        F.sort_array(F.collect_list(F.struct("k", "head", "between", "tail"))).alias("maps"),
    )

    def composed(batches):
        of = counter(path)
        for batch in batches:
            totals = [of.scan([(m["head"], m["between"], m["tail"]) for m in row]) for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(totals, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    scanned = joined.select("doc_id", "n_bytes", "maps").mapInArrow(composed, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.unionByName(scanned).withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))
