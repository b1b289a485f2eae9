"""Operator 8: byte-level BPE encoding and decoding.

Method: the merges become a lazily determinised transducer (``bpe_fst``) that emits tokens after
bounded lookahead; decoding is a stream of ids through an incremental UTF-8 state machine whose
steps are precomputed per token.

A null text counts as empty: no tokens, digests of nothing. Any id passes through, null and
repeated ones too. Texts are independent, so the work needs no shuffle; memory is one Arrow
batch plus bounded memo tables.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from reviewsift.llm import common
from reviewsift.llm.bpe_fst import MergeRules, Transducer, read_ranks

RANKS = "byte_bpe_50k.tiktoken"
#: States of the transducer that a worker keeps; words whose tokens it keeps, in each of two
#: generations of the memo table, are three quarters of that. About a kilobyte for each state.
STATES = 200_000
_BLOCK = 1 << 15


def piece_pattern(pattern: str) -> regex.Pattern:
    """The split pattern with white space as the Unicode property, which excludes U+001C to U+001F."""
    inside = pattern.replace(r"[^\s", r"[^\p{White_Space}")
    return regex.compile(inside.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Utf8Machine:
    """States: 0 between characters, 1 to 3 that many continuation bytes left, 4 to 7 a first
    continuation byte of limited range, 8 not UTF-8."""

    BAD = 8
    #: Fixed values of the encoding: (lead bytes, next state).
    LEADS = ((0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7))
    #: (state, first and last byte allowed, next state).
    FOLLOW = ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2))

    def __init__(self) -> None:
        self.next = np.full((9, 256), self.BAD, np.uint8)
        self.next[0, :0x80] = 0
        for first, last, state in self.LEADS:
            self.next[0, first : last + 1] = state
        for state, first, last, after in self.FOLLOW:
            self.next[state, first : last + 1] = after

    def over(self, data: bytes) -> np.ndarray:
        """Where each state ends after reading some bytes."""
        at = np.arange(9)
        for byte in data:
            at = self.next[at, byte]
        return at


class StreamDecoder:
    """Ids to bytes in blocks; ``state`` is 0 whenever all characters so far are complete."""

    def __init__(self, codec: ByteBpe):
        self.codec, self.state = codec, 0

    def feed(self, ids: np.ndarray) -> bytes:
        codec = self.codec
        odd = np.flatnonzero(~codec.whole[ids])
        at = -1
        for k in odd.tolist():
            if k <= at:
                continue
            at = k
            while at < len(ids):
                self.state = int(codec.over[ids[at], self.state])
                if self.state == 0 or self.state == Utf8Machine.BAD:
                    break
                at += 1
        return b"".join(map(codec.token_bytes.__getitem__, ids.tolist()))


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str, states: int = STATES):
        ranks = read_ranks(path)
        self.rules = MergeRules({token.decode("latin-1"): rank for token, rank in ranks.items()}, None)
        self.machine = Transducer(self.rules, states)
        self.most_words = 3 * states // 4
        self.find = piece_pattern(pattern).findall
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        utf8 = Utf8Machine()
        self.over = np.array([utf8.over(token) for token in self.token_bytes], np.uint8)
        self.whole = self.over[:, 0] == 0
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def word(self, piece: str) -> bytes:
        """Ids of one match of the pattern, as little-endian 32-bit integers."""
        if (made := self.older.get(piece)) is not None:
            self.memo[piece] = made
            return made
        symbols = piece.encode("utf-8").decode("latin-1")
        whole = self.rules.ids.get(symbols)
        ids = [whole] if whole is not None else self.machine.tokens(symbols)
        coded = array("I", ids)
        if np.little_endian is False:
            coded.byteswap()
        made = coded.tobytes()
        if len(piece) <= 64 and len(self.memo) < 2 * self.most_words:
            self.memo[piece] = made
        return made

    def encode(self, text: str) -> bytes:
        if len(self.memo) >= self.most_words:
            self.older, self.memo = self.memo, {}
        known, word = self.memo.get, self.word
        return b"".join([known(piece) or word(piece) for piece in self.find(text)])

    def decode(self, coded: bytes) -> Iterator[bytes]:
        """The bytes of ids, block by block, through the UTF-8 state machine."""
        ids = np.frombuffer(coded, "<u4")
        stream = StreamDecoder(self)
        for start in range(0, len(ids), _BLOCK):
            yield stream.feed(ids[start : start + _BLOCK])
        if stream.state:
            raise ValueError("the ids end inside a character or are not UTF-8")


_codecs: dict[tuple[str, str, int], ByteBpe] = {}


def codec(path: str, pattern: str, states: int = STATES) -> ByteBpe:
    """One codec per Python worker."""
    key = (path, pattern, states)
    if key not in _codecs:
        _codecs[key] = ByteBpe(*key)
    return _codecs[key]


#: What ``encode_decode`` can return, with the type of each.
OUTPUTS = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_decode(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    pattern: str | None = None,
    outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
    states: int = STATES,
) -> DataFrame:
    """One row per input row: ``doc_id`` and the chosen ``OUTPUTS``; other columns are left out.

    ``states`` trades memory of the Python workers for speed; results do not depend on it.
    """
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    source = common.narrow(df, id_col, text_col)

    def work(texts: list[str | None]) -> list[list]:
        bpe = codec(path, pattern, states)
        columns: dict[str, list] = {name: [] for name in outputs}
        for text in texts:
            coded = bpe.encode(text or "")
            digest, pieces = hashlib.sha256(), []
            for block in bpe.decode(coded):
                digest.update(block)
                if "decoded" in columns:
                    pieces.append(block)
            made = {
                "n_tokens": lambda: len(coded) // 4,
                "ids": lambda: np.frombuffer(coded, "<u4").astype(np.int32),
                "decoded": lambda: b"".join(pieces).decode("utf-8"),
                "ids_sha256": lambda: hashlib.sha256(coded).hexdigest(),
                "decoded_sha256": digest.hexdigest,
            }
            for name, values in columns.items():
                values.append(made[name]())
        return [columns[name] for name in outputs]

    schema = ", ".join([f"doc_id {common.id_type(source)}", *(f"{name} {OUTPUTS[name]}" for name in outputs)])
    return common.map_texts(source, work, schema, list(outputs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes, per document."""
    documents = common.table(spark, sf_dir, "documents")
    return encode_decode(documents, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
