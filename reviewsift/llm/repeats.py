"""Operator 5: removal of long byte strings that an earlier document already has.

Every byte that is covered by a ``WINDOW``-byte string (50 bytes) which also starts in a document
with a smaller id is removed; strings are judged on the input, and matches never cross documents.

Method: suffixes of many strings are ordered by building the Burrows-Wheeler transform of their
collection column by column, with common prefixes (``column_bwt``): suffixes that share at least
50 symbols stand side by side, so the smallest document of each such run owns the string. One
collection of all texts would need as many rounds as the longest text has bytes, and could not be
spread out. So texts are cut into overlapping *segments* of at most 84 bytes: runs of windows with
the same minimiser, the least hash of the 16-byte strings in a window. Equal windows have equal
minimisers, so each minimiser's segments form a collection of their own and all rounds together
are at most 84.

1. Equal texts are named by digest; all but the smallest id are removed whole (if long enough).
2. Documents are partitioned by id once. Each partition sends its distinct minimisers around;
   those that another document has come back as *shared*. Only segments of shared ones move.
3. Segments that are equal inside a partition are combined, those of some minimisers at a time (so
   it doesn't matter how many are shared): later documents lose theirs at once.
   What remains is grouped by minimiser. A minimiser in more than ``HOT`` segments is split:
   its windows go around one by one, by their own hash.
4. Each task orders the collections it got, a bounded number of strings at a time, and reports
   the removed byte ranges, which are joined with the partitioned texts.

Equal strings of a collection enter the transform once, cut to what the likest other string
shares with them around the minimiser; a collection of one string has no order
to find out and its smallest document owns it.

Edge cases: a null text has no bytes; rows with a null id lose nothing and take nothing away;
rows that share an id never take from each other. Ids are integers.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewsift.llm import common
from reviewsift.llm.column_bwt import suffixes
from reviewsift.llm.shingles import mix, powers

WINDOW = 50
GRAM = 16
#: Windows that can share one place of a minimiser: the longest segment.
REACH = WINDOW - GRAM + 1
#: Segments of a minimiser beyond which its windows are spread.
HOT = 4_096
#: Strings of a collection that are ordered at a time; single collections may be larger.
BATCH = 6_000
#: Segments of a partition that are combined at a time, as objects.
ROUND = 100_000
_PIECE = 1 << 18


def _minimisers(data: np.ndarray) -> np.ndarray:
    """Minimiser of the window at each place of ``data``."""
    n = len(data)
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    least = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    width = 1
    while 2 * width <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = REACH - width
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, windows, minimiser) of every segment, in order. A text is worked on in pieces
    of a quarter of a megabyte that overlap by a window; short texts share a piece."""
    found: list[tuple] = []
    group: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        if not group:
            return
        data = np.frombuffer(b"".join(x for _, _, x in group), np.uint8)
        firsts = np.cumsum([0, *(len(x) for _, _, x in group)])[:-1]
        if len(data) >= WINDOW:
            least = _minimisers(data)
            edge = np.zeros(len(data) + 2, np.int8)
            for first, (_, _, piece) in zip(firsts.tolist(), group):
                edge[first] += 1
                edge[first + len(piece) - WINDOW + 1] -= 1
            valid = np.cumsum(edge)[: len(least)] > 0
            begins = valid.copy()
            begins[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
            starts = np.flatnonzero(begins)
            stops = np.flatnonzero(np.append(begins[1:] | ~valid[1:], True) & valid) + 1
            # Long runs (one string repeating itself) are cut to the longest segment.
            parts = -(-(stops - starts) // REACH)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            start = np.repeat(starts, parts) + nth * REACH
            windows = np.minimum(np.repeat(stops, parts) - start, REACH)
            piece = np.searchsorted(firsts, start, side="right") - 1
            text = np.array([t for t, _, _ in group])[piece]
            offset = np.array([o for _, o, _ in group])[piece]
            found.append((text, start - firsts[piece] + offset, windows, least[start]))
        group.clear()

    size = 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - WINDOW + 1), _PIECE):
            piece = text[at : at + _PIECE + WINDOW - 1]
            if len(piece) >= WINDOW:
                group.append((k, at, piece))
                size += len(piece)
        if size >= _PIECE:
            flush()
            size = 0
    flush()
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _parts(batches: Iterator[pa.RecordBatch]) -> dict[int, list[dict]]:
    """The rows of a task by partition number (one, unless partitions were put together)."""
    parts: dict[int, list[dict]] = {}
    for row in _rows(batches):
        parts.setdefault(row["part"], []).append(row)
    return parts


def _announce(docs: DataFrame, buckets: int) -> DataFrame:
    """Per partition and bucket: its distinct minimisers, in how many segments each is, and whether
    more than one of its documents has it."""

    def run(batches):
        for part, rows in sorted(_parts(batches).items()):
            rows = [r for r in rows if r["text"] is not None and not r["copy"]]
            text, _, _, least = segments([r["text"] for r in rows])
            if not len(text):
                continue
            ids = np.array([r["doc_id"] for r in rows], np.int64)[text]
            order = np.lexsort((ids, least))
            least, ids = least[order], ids[order]
            first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
            counts = np.minimum(np.diff(np.append(first, len(least))), 65_535).astype(np.uint16)
            several = (ids[np.append(first[1:], len(ids)) - 1] != ids[first]).astype(np.uint8)
            least = least[first]
            bucket = (least % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, least, counts, several = bucket[order], least[order], counts[order], several[order]
            edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
            for k in range(0, len(spans), 1000):
                some = spans[k : k + 1000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(bucket[a]) for a, _ in some], pa.int32()),
                        pa.array([rows[0]["doc_id"]] * len(some), pa.int64()),
                        *(pa.array([x[a:b].tobytes() for a, b in some], pa.binary()) for x in (least, counts, several)),
                    ],
                    names=["bucket", "owner", "least", "counts", "several"],
                )

    return docs.mapInArrow(run, "bucket int, owner bigint, least binary, counts binary, several binary")


def _answer(announced: DataFrame) -> DataFrame:
    """For each partition (named by a document of it): its shared minimisers, and which are hot."""

    def run(batches):
        rows = list(_rows(batches))
        if not rows:
            return
        least = np.concatenate([np.frombuffer(r["least"], np.uint64) for r in rows])
        counts = np.concatenate([np.frombuffer(r["counts"], np.uint16) for r in rows]).astype(np.int64)
        several = np.concatenate([np.frombuffer(r["several"], np.uint8) for r in rows]) > 0
        owner = np.repeat(np.arange(len(rows)), [len(r["counts"]) // 2 for r in rows])
        order = np.argsort(least, kind="stable")
        least, counts, several, owner = least[order], counts[order], several[order], owner[order]
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        size = np.diff(np.append(first, len(least)))
        shared = np.repeat((size > 1) | np.logical_or.reduceat(several, first), size)
        hot = np.repeat(np.add.reduceat(counts, first) > HOT, size)
        by = np.argsort(owner[shared], kind="stable")
        owner, least, hot = owner[shared][by], least[shared][by], hot[shared][by]
        edges = np.searchsorted(owner, np.arange(len(rows) + 1))
        for k, row in enumerate(rows):
            a, b = edges[k], edges[k + 1]
            if b > a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["owner"]], pa.int64()), pa.array([least[a:b].tobytes()], pa.binary()), pa.array([hot[a:b].astype(np.uint8).tobytes()], pa.binary())],
                    names=["owner", "shared", "hot"],
                )

    return announced.mapInArrow(run, "owner bigint, shared binary, hot binary")


def rounds(least: np.ndarray, sizes: np.ndarray, parts: int) -> Iterator[np.ndarray]:
    """Segments of about ``ROUND`` in all at a time, in their order: those whose minimisers go to neighbouring
    ones of ``parts``, so that what goes to a part is written as if there were one round."""
    many = -(-int(sizes.sum()) // ROUND)
    to = least.view(np.int64) % parts * many // parts
    for k in range(many):
        yield np.flatnonzero(to == k)


def _send(docs: DataFrame, buckets: int) -> DataFrame:
    """Segments of shared minimisers, combined inside the partition, and ranges that are decided."""

    def run(batches):
        for _, rows in sorted(_parts(batches).items()):
            answers = [a for r in rows for a in (r["answers"] or ())]
            if not answers:
                continue
            shared = np.concatenate([np.frombuffer(a["shared"], np.uint64) for a in answers])
            hot = np.concatenate([np.frombuffer(a["hot"], np.uint8) for a in answers])
            order = np.argsort(shared, kind="stable")
            shared, hot = shared[order], hot[order]
            own = sorted((r for r in rows if r["text"] is not None and not r["copy"]), key=lambda r: (r["doc_id"], r["sub"]))
            text, start, windows, least = segments([r["text"] for r in own])
            place = np.minimum(np.searchsorted(shared, least), len(shared) - 1)
            mine = shared[place] == least
            text, start, windows, least, is_hot = text[mine], start[mine], windows[mine], least[mine], hot[place[mine]]
            ids = [r["doc_id"] for r in own]
            bodies = [r["text"] for r in own]
            decided: dict[int, array] = {}

            def pieces(some: np.ndarray):
                """(key, string, row, place) of every segment, or of its windows where it is hot."""
                columns = (text[some], start[some], start[some] + windows[some] + (WINDOW - 1), least[some].view(np.int64), is_hot[some])
                for k, at, stop, key, spread in zip(*(c.tolist() for c in columns)):
                    body = bodies[k]
                    if not spread:
                        yield key, body[at:stop], k, at
                        continue
                    for w in range(at, stop - WINDOW + 1):
                        content = body[w : w + WINDOW]
                        yield int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True), content, k, w

            def rows_of(out: list[tuple]) -> Iterator[pa.RecordBatch]:
                for a in range(0, len(out), 20_000):
                    some = out[a : a + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([x[0] for x in some], pa.int64()),
                            pa.array([x[1] for x in some], pa.binary()),
                            pa.array([ids[x[2]] for x in some], pa.int64()),
                            pa.array([own[x[2]]["sub"] for x in some], pa.int64()),
                            pa.array([np.array(x[3], np.int32).tobytes() for x in some], pa.binary()),
                        ],
                        names=["key", "content", "doc_id", "sub", "places"],
                    )

            # Equal segments have the same minimiser, so they meet in one round; documents keep their order.
            for some in rounds(least, np.where(is_hot, windows, 1), buckets):
                first_of: dict[tuple[int, bytes], list] = {}
                for key, content, k, at in pieces(some):
                    held = first_of.get((key, content))
                    if held is None:
                        first_of[(key, content)] = [k, [at], None]
                    elif ids[held[0]] < ids[k]:
                        decided.setdefault(k, array("i")).extend((at, at + len(content)))
                    elif held[0] == k:
                        held[1].append(at)
                    else:  # another row of the same id
                        held[2] = held[2] or {}
                        held[2].setdefault(k, []).append(at)
                yield from rows_of([(key, content, k, starts) for (key, content), held in first_of.items() for k, starts in ((held[0], held[1]), *(held[2] or {}).items())])
            yield from rows_of([(ids[k] * 0x9E3779B1 % (1 << 62), None, k, spans) for k, spans in decided.items()])

    return docs.mapInArrow(run, "key bigint, content binary, doc_id bigint, sub bigint, places binary")


def _common(minimisers: np.ndarray, sides: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many bytes of its side each string shares with the likest string of the same minimiser."""
    rows = np.hstack([minimisers.astype(">u8").view(np.uint8).reshape(-1, 8), sides])
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    same = rows[order][1:] == rows[order][:-1]
    shared = np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1)) - 8
    most = np.zeros(len(rows), np.int64)
    most[order[1:]] = shared
    most[order[:-1]] = np.maximum(most[order[:-1]], shared)
    return np.clip(most, 0, lengths)


def _trimmed(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(strings, starts, lengths): the parts of strings that another string may share.

    All windows of a string hold its minimiser, so a shared window reaches no farther from it, to
    either side, than the likest string does. Where a minimiser stands twice in a string nothing
    is cut from the strings that have it.
    """
    n = len(text)
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    grams = np.full(n + 1, np.uint64(0xFFFFFFFFFFFFFFFF))
    grams[: n - GRAM + 1] = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    places = lengths - GRAM + 1
    edges = np.stack([starts, starts + places], 1).reshape(-1)
    least = np.minimum.reduceat(grams, edges)[0::2]
    owner = np.repeat(np.arange(len(starts)), places)
    place = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(places) - places), places)
    hits = np.flatnonzero(grams[place] == least[owner])
    first = np.searchsorted(owner[hits], np.arange(len(starts) + 1))
    at = place[hits[first[:-1]]]
    whole = np.isin(least, least[np.diff(first) > 1])
    steps = np.arange(REACH - 1)
    ends = starts + lengths
    padded = np.append(text, np.full(2 * REACH, 255, np.uint8))
    right = at[:, None] + GRAM + steps
    left = at[:, None] - 1 - steps
    to_right = _common(least, np.where(right < ends[:, None], padded[right], 255).astype(np.uint8), ends - at - GRAM)
    to_left = _common(least, np.where(left >= starts[:, None], padded[np.maximum(left, 0)], 255).astype(np.uint8), at - starts)
    begin = np.where(whole, starts, at - to_left)
    size = np.where(whole, lengths, to_left + GRAM + to_right)
    strings = np.flatnonzero(size >= WINDOW)
    return strings, begin[strings], size[strings]


def owned_windows(contents: list[bytes], docs: np.ndarray) -> dict[int, np.ndarray]:
    """For strings and the smallest document of each: by string, the places of windows that a smaller
    document has, in the strings of this collection."""
    lengths = np.array([len(c) for c in contents], np.int64)
    text = np.frombuffer(b"".join(contents), np.uint8)
    starts = np.cumsum(lengths) - lengths
    kept, begin, size = _trimmed(text, starts, lengths)
    if not len(kept):
        return {}
    found = [np.concatenate(x) for x in zip(*suffixes(text, begin, size, WINDOW))]
    string, length, shared = found[:3]
    run = np.cumsum(shared < WINDOW)
    whole = length >= WINDOW
    string, length, run = string[whole], length[whole], run[whole]
    if not len(run):
        return {}
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    own = docs[kept[string]]
    least = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(run))))
    lost = own > least
    at = (size[string] - length + begin[string] - starts[kept[string]])[lost]
    string = kept[string][lost]
    order = np.lexsort((at, string))
    string, at = string[order], at[order]
    names, first = np.unique(string, return_index=True)
    return dict(zip(names.tolist(), np.split(at, first[1:])))


def _decide(sent: DataFrame) -> DataFrame:
    """(doc_id, sub, spans): removed ranges, from segments sorted by key."""

    def ranges(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Ranges of windows at places ``at`` of a string that stands at each of ``starts``."""
        cut = np.flatnonzero(np.append(True, np.diff(at) > 1))
        low, high = at[cut], at[np.append(cut[1:], len(at)) - 1] + WINDOW
        return (starts[:, None, None] + np.stack([low, high], 1)[None]).reshape(-1).astype(np.int32)

    def run(batches):
        contents: list[bytes] = []
        smallest: list[int] = []
        holders: list[list[tuple]] = []
        out: list[tuple[int, int, bytes]] = []

        def group_done(rows: list[tuple]) -> None:
            """Rows (key, content, doc_id, sub, places) of one key."""
            by_content: dict[bytes, list[tuple]] = {}
            for row in rows:
                held = by_content.get(row[1])
                if held is None:
                    by_content[row[1]] = [row]
                else:
                    held.append(row)
            for content, held in by_content.items():
                least = held[0][2] if len(held) == 1 else min(r[2] for r in held)
                if len(held) > 1:
                    for r in held:
                        if r[2] > least:
                            out.append((r[2], r[3], whole(r[4], len(content))))
                if len(by_content) > 1:
                    contents.append(content)
                    smallest.append(least)
                    holders.append([r for r in held if r[2] == least])

        def whole(places: bytes, length: int) -> bytes:
            """The ranges of a string at each of its places."""
            if len(places) == 4:
                return places + (int.from_bytes(places, "little") + length).to_bytes(4, "little")
            starts = np.frombuffer(places, np.int32)
            return np.stack([starts, starts + length], 1).astype(np.int32).tobytes()

        def order() -> None:
            if contents:
                for k, at in owned_windows(contents, np.array(smallest, np.int64)).items():
                    for r in holders[k]:
                        out.append((r[2], r[3], ranges(at, np.frombuffer(r[4], np.int32)).tobytes()))
            contents.clear()
            smallest.clear()
            holders.clear()

        def flushed() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())],
                    names=["doc_id", "sub", "spans"],
                )
                out.clear()

        key, rows = None, []
        for row in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
            if row[1] is None:
                out.append((row[2], row[3], row[4]))
                continue
            if row[0] != key:
                if len(rows) > 1:
                    group_done(rows)
                key, rows = row[0], []
                if len(contents) >= BATCH:
                    order()
                if len(out) >= 20_000:
                    yield from flushed()
            rows.append(row)
        if len(rows) > 1:
            group_done(rows)
        order()
        yield from flushed()

    return sent.mapInArrow(run, "doc_id bigint, sub bigint, spans binary")


def _removed(docs: DataFrame, kept_text: bool) -> DataFrame:
    """Counts, ranges and digest of what is left of each row."""

    def run(batches):
        for batch in common.slices(batches):
            out = []
            for row in batch.to_pylist():
                body = row["text"] or b""
                if row["copy"] and len(body) >= WINDOW:
                    gone = np.array([[0, len(body)]])
                else:
                    spans = [np.frombuffer(x["spans"], np.int32) for x in (row["found"] or ()) if x["sub"] == row["sub"]]
                    gone = np.concatenate(spans).reshape(-1, 2).astype(np.int64) if spans else np.zeros((0, 2), np.int64)
                if len(gone):
                    gone = gone[np.argsort(gone[:, 0], kind="stable")]
                    reach = np.maximum.accumulate(gone[:, 1])
                    first = np.flatnonzero(np.append(True, gone[1:, 0] > reach[:-1]))
                    gone = np.stack([gone[first, 0], reach[np.append(first[1:], len(gone)) - 1]], 1)
                edges = [0, *gone.reshape(-1).tolist(), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[0::2], edges[1::2]))
                out.append((row["doc_id"], len(body), len(body) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept if kept_text else None))
            columns = [pa.array([x[0] for x in out], pa.int64()), *(pa.array([x[i] for x in out], pa.int64()) for i in (1, 2, 3)), pa.array([x[4] for x in out], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if kept_text:
                columns.append(pa.array([x[5] for x in out], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * kept_text)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_text: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept``, the
    remaining bytes (they need not be UTF-8: a range may begin inside a character)."""
    n = common.partitions(df)
    docs = common.narrow(df, id_col, text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode("text", "UTF-8").alias("text"))
    named = docs.where(F.col("doc_id").isNotNull())
    sub = F.xxhash64("text")

    digests = named.where(F.col("text").isNotNull()).select("doc_id", sub.alias("sub"), F.sha2("text", 256).alias("digest"))
    least = digests.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1").select("digest", "least")
    copies = digests.join(least, "digest").where("doc_id > least").groupBy("doc_id").agg(F.collect_set("sub").alias("copies"))

    # One exchange of the texts serves all three passes over them.
    texts = named.repartition(n, "doc_id")
    flagged = texts.join(copies, "doc_id", "left").select(
        "doc_id", "text", sub.alias("sub"), F.coalesce(F.array_contains("copies", sub), F.lit(False)).alias("copy"), F.pmod(F.hash("doc_id"), F.lit(n)).alias("part")
    )
    announced = _announce(flagged, n).repartition(n, "bucket")
    answers = _answer(announced).groupBy(F.col("owner").alias("doc_id")).agg(F.collect_list(F.struct("shared", "hot")).alias("answers"))
    sent = _send(flagged.join(answers, "doc_id", "left"), n).repartitionById(n, F.pmod("key", F.lit(n)).cast("int")).sortWithinPartitions("key")
    found = _decide(sent).groupBy("doc_id").agg(F.collect_list(F.struct("sub", "spans")).alias("found"))
    done = _removed(flagged.join(found, "doc_id", "left"), kept_text)
    nameless = docs.where(F.col("doc_id").isNull()).select(
        "doc_id", "text", sub.alias("sub"), F.lit(False).alias("copy"), F.lit(None).cast("array<struct<sub:bigint,spans:binary>>").alias("found")
    )
    return done.unionByName(_removed(nameless, kept_text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"), kept_text=False)
