import tracemalloc

import numpy as np
import pyarrow as pa

from reviewsift.llm import repeats


class Captured:
    """Stands for a table: the function that its tasks would run."""

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_rounds_hold_each_segment_once_and_equal_minimisers_together(monkeypatch):
    monkeypatch.setattr(repeats, "ROUND", 100)
    least = np.random.default_rng(1).integers(0, 1 << 63, 400).astype(np.uint64)[np.random.default_rng(2).integers(0, 400, 3000)]
    found = list(repeats.rounds(least, np.ones(3000, np.int64), 64))
    assert sorted(np.concatenate(found).tolist()) == list(range(3000)) and len(found) == 30
    assert all((np.diff(f) > 0).all() for f in found if len(f))
    homes = [set(least[f].tolist()) for f in found]
    assert sum(map(len, homes)) == len(set(least.tolist()))
    assert max(map(len, found)) < 400
    assert list(repeats.rounds(least[:0], np.ones(0, np.int64), 64)) == []


def test_shared_segments_of_a_partition_are_not_held_at_once(monkeypatch):
    """Where nearly all is shared, a partition's segments took 500 bytes each as objects."""
    monkeypatch.setattr(repeats, "ROUND", 4_000, raising=False)
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 123, 4_000).astype(np.uint8).tobytes() for _ in range(400)]
    texts[7] = texts[3][:2_000] + texts[7][2_000:]
    least = np.unique(repeats.segments(texts)[3])
    many = len(repeats.segments(texts)[3])
    answers = [{"shared": least.tobytes(), "hot": np.zeros(len(least), np.uint8).tobytes()}]
    rows = [{"doc_id": k, "text": t, "sub": k, "copy": False, "part": 0, "answers": answers if k == 0 else None} for k, t in enumerate(texts)]
    batch = pa.RecordBatch.from_pylist(rows)
    try:
        run = repeats._send(Captured(), 64)
    except TypeError:
        run = repeats._send(Captured())
    tracemalloc.start()
    sent = lost = 0
    for out in run(iter([batch])):
        contents = out.column(1).to_pylist()
        sent += sum(c is not None for c in contents)
        lost += sum(k == 7 and c is None for c, k in zip(contents, out.column(2).to_pylist()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lost == 1 and 0.95 * many < sent < many
    assert peak < 250 * many


def test_repeats_are_found_whatever_the_exchange(spark):
    """All strings of 50 bytes, by brute force, for several numbers of partitions."""
    rng = np.random.default_rng(8)
    blocks = [rng.integers(97, 123, 120).astype(np.uint8).tobytes().decode() for _ in range(6)]
    texts = ["".join(blocks[j] for j in rng.integers(0, 6, 3)) + f" end {k}" for k in range(40)]
    want, seen = {}, set()
    for k, text in enumerate(texts):
        own = [text[a : a + 50] for a in range(len(text) - 49)]
        gone = {b for a, w in enumerate(own) if w in seen for b in range(a, a + 50)}
        want[k] = len(gone)
        seen |= set(own)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 3, 8):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(df).select("doc_id", "n_removed").collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
