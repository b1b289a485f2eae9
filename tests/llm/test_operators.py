"""The training-data operators against libraries, SQL and brute force, on edge cases and small tables."""

from __future__ import annotations

import collections
import datetime
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

pytest.importorskip("reviewsift.llm")

from pyspark.sql import functions as F  # noqa: E402

from reviewsift.llm import (  # noqa: E402
    byte_bpe,
    column_bwt,
    decontaminate,
    exact_dedup,
    ngram_join,
    pseudonyms,
    repeats,
    secrets_scan,
    sharding,
    shingles,
    token_count,
    toxicity,
)
from reviewsift.llm.graph import components  # noqa: E402
from tools.check_oracle import compare, connect  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, token string, part int, size int, n int"
WHITE = re.compile(r"[\x20\x09-\x0D]+")
ITEM = "the quick brown fox jumps over the lazy dog while seven wizards make toxic brew for the evil queen and jack"


def edge_rows():
    rng = random.Random(7)
    words = ["alpha", "beta", "Gamma", "délta", "ε", "zeta", "eta.", "theta,"]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    base = " ".join(f"w{rng.randint(0, 400)}" for _ in range(120))
    near = base.replace("w1", "x1", 1)
    texts = [None, "", " \n\t", "a b", "a b", "A  b", long, long + " tail", base, base, near, "😀 ünï <|startoftext|>", "x" * 5000, "\x00nul", f"so {ITEM}, yes"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "a b"), (None, base), (None, None), (8, base)]
    return [(i, t, "en", "s", 1, "c", 2, 3, 4) for i, t in rows]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, small):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- 8 and 6: tokenizers


def encodings():
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    from reviewsift.llm.bpe_fst import read_ranks

    ranks = read_ranks(public_tokenizers.path(byte_bpe.RANKS))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own, Tokenizer.from_file(public_tokenizers.path(token_count.TOKENIZER))


def strange_texts():
    rng = random.Random(1)
    alphabet = "abcdefgh  \n\t'sSΣσİé́ \x1c\x1f12345½²…!?<|>中文字😀-_the"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return texts + ["it's don't WE'LL <|startoftext|>x<|endoftext|> y", "ΌΣΟΣ ΑΣ STRASSE ẞ", "a" * 700, " " * 90 + "x", "abab" * 90]


def test_encoding_equals_library(documents):
    import public_tokenizers

    library, _ = encodings()
    codec = byte_bpe.ByteBpe(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)
    for text in strange_texts() + [t for _, t in documents[:60]]:
        coded = codec.encode(text)
        assert np.frombuffer(coded, "<u4").tolist() == library.encode_ordinary(text)
        assert b"".join(codec.decode(coded)) == text.encode()


def test_decoder_rejects_a_broken_stream():
    import public_tokenizers

    codec = byte_bpe.codec(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)
    half = np.frombuffer(codec.encode("é"), "<u4")
    lead = next(i for i, t in enumerate(codec.token_bytes) if t == b"\xc3")
    assert b"".join(codec.decode(half.tobytes())) == "é".encode()
    with pytest.raises(ValueError):
        list(codec.decode(np.array([lead], "<u4").tobytes()))


def test_counts_equal_library(documents):
    import public_tokenizers

    _, library = encodings()
    counter = token_count.Counter(public_tokenizers.path(token_count.TOKENIZER))
    for text in strange_texts() + [t for _, t in documents[:60]]:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_chunk_maps_compose(documents):
    import public_tokenizers

    counter = token_count.counter(public_tokenizers.path(token_count.TOKENIZER))
    for text in strange_texts()[:150] + [t[:300] for _, t in documents[:20]]:
        for size in (1, 3, 50):
            maps = [counter.chunk_map(text[k : k + size]) for k in range(0, len(text), size)] or [("", None, None)]
            assert counter.scan(maps) == counter.count(text)


def test_token_operators_on_edges(edge, empty):
    own, library = encodings()
    rows = edge_rows()
    got = token_count.count_tokens(edge, chunk=1000).collect()
    want = collections.Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    coded = byte_bpe.encode_decode(edge).collect()
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in coded) == collections.Counter(
        (i, tuple(own.encode_ordinary(t or "")), t or "") for i, t, *_ in rows
    )
    assert token_count.count_tokens(empty).count() == byte_bpe.encode_decode(empty).count() == 0


# --- 3: exact dedup


def brute_groups(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[WHITE.sub("", t or "")].append((i, t or ""))
    return groups


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda norm: F.substring(F.sha2(norm, 256), 1, 1)])
def test_exact_dedup(edge, digest):
    rows = [(r[0], r[1]) for r in edge_rows()]
    want = collections.Counter()
    for norm, members in brute_groups(rows).items():
        longest = max(len(t) for _, t in members)
        ids = [i for i, t in members if len(t) == longest and i is not None]
        keep = min(ids) if ids else None
        for i, _ in members:
            want[(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())] += 1
    got = exact_dedup.deduplicate(edge, salts=3, digest=digest).collect()
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want


def test_exact_dedup_empty(empty):
    assert exact_dedup.deduplicate(empty).count() == 0


# --- 7: Jaccard join


def brute_components(rows, width=5):
    sets = {}
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = [x for x in WHITE.split(low) if x]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join_edges(edge, empty):
    rows = [(r[0], r[1]) for r in edge_rows()]
    want = brute_components([r for r in rows if r[0] is not None])
    for r in ngram_join.components_by_shingles(edge).collect():
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        else:
            assert r["component_id"] is None
    assert ngram_join.components_by_shingles(empty).count() == 0


def test_ngram_join_crowded(spark):
    """Families of near copies and frequent passages, with lists cut short so that leaders decide."""
    rng = random.Random(5)
    word = lambda: f"v{rng.randint(0, 5000)}"
    passage = [word() for _ in range(30)]
    rows = []
    for family in range(4):
        base = [word() for _ in range(60)] + passage
        for _ in range(18):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
    for _ in range(30):
        rows.append((len(rows), " ".join([word() for _ in range(rng.randint(1, 60))] + passage[: rng.randint(0, 30)])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = brute_components(rows)
    for block in (2, 6, 16):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.components_by_shingles(df, block=block).collect()}
        assert got == want


def crowd_rows():
    """One family around a text: close copies, copies at the edge of a link, chains that walk away from it by
    small steps, a second family at a distance where some of its members touch the first, and other texts
    that hold one long passage of it."""
    rng = random.Random(21)
    word = lambda: f"v{rng.randint(0, 50_000)}"
    base = [word() for _ in range(120)]

    def edited(text, n):
        text = list(text)
        for at in rng.sample(range(len(text)), n):
            text[at] = word()
        return text

    rows = [edited(base, rng.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 8])) for _ in range(160)]
    for _ in range(6):
        walk = base
        for _ in range(6):
            walk = edited(walk, 2)
            rows.append(walk)
    second = edited(base, 3)[:100] + [word() for _ in range(12)]
    rows += [edited(second, rng.randint(0, 4)) for _ in range(60)]
    rows += [base[: rng.randint(90, 120)] for _ in range(20)]
    rows += [[word() for _ in range(rng.randint(5, 60))] + base[20:60] for _ in range(60)]
    rng.shuffle(rows)
    return [(k, " ".join(r)) for k, r in enumerate(rows)]


@pytest.mark.parametrize("block", [4, 16])
def test_ngram_join_around_one_text(spark, monkeypatch, block):
    """Sets that lead themselves one by one, so that open pairs take several rounds."""
    monkeypatch.setattr(ngram_join, "FIRST_OPEN", 1)
    monkeypatch.setattr(ngram_join, "MORE_OPEN", 3)
    rows = crowd_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.components_by_shingles(df, block=block).collect()}
    assert got == brute_components(rows)


def test_ngram_join_does_not_pair_a_family(spark, monkeypatch):
    """Of the pairs of a family and its copies few are measured in step 4."""
    made = []
    real = ngram_join._against

    def counted(leaders, ordered, sets, percent):
        found = real(leaders, ordered, sets, percent)
        made.append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "_against", counted)
    rows = crowd_rows()
    many = rows + [(len(rows) + k, f"{t} again") for k, t in rows]
    assert ngram_join.components_by_shingles(spark.createDataFrame(many, "doc_id bigint, text string")).count() == len(many)
    assert 0 < sum(made) < 0.02 * len(many) ** 2


def test_ngram_join_query_equals_sql(spark, small):
    assert compare(ngram_join.query(spark, small), connect(small).sql(ngram_join.ORACLE)) == ""


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 130)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_shingles_of_long_and_short_texts_agree(monkeypatch):
    texts = ["One two\tthree four five six", "one", "", None, "é " * 50, "a b c d e f g h i j k"]
    whole = [x.tolist() for x in shingles.shingle_sets(texts, 5)]
    monkeypatch.setattr(shingles, "_BLOCK", 16)
    assert [x.tolist() for x in shingles.shingle_sets(texts, 5)] == whole


# --- 5: repeats


def test_column_bwt(monkeypatch):
    rng = random.Random(3)
    for _ in range(60):
        monkeypatch.setattr(column_bwt, "BLOCK", rng.choice([3, 7, 1 << 20]))
        monkeypatch.setattr(column_bwt, "IN_MEMORY", rng.choice([0, 1 << 20]))
        letters = rng.choice([b"ab", b"abcdefghij"])
        strings = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 20))]
        lengths = np.array([len(s) for s in strings])
        data = np.frombuffer(b"".join(strings) or b"x", np.uint8)
        s, n, common, before = (np.concatenate(x) for x in zip(*column_bwt.suffixes(data, np.cumsum(lengths) - lengths, lengths, 50)))
        want = sorted((strings[i][len(strings[i]) - k :], i, k) for i in range(len(strings)) for k in range(len(strings[i]) + 1))
        assert [(i, k) for i, k in zip(s.tolist(), n.tolist())] == [(i, k) for _, i, k in want]
        for k in range(1, len(want)):
            a, b = want[k - 1][0], want[k][0]
            assert common[k] == next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
        for (_, i, k), c in zip(want, before.tolist()):
            assert c == (0 if k == len(strings[i]) else strings[i][-k - 1] + 1)


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            if i is not None:
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k + 1 : k + 51] = True
        kept = np.frombuffer(b, np.uint8)[~gone[1:-1]].tobytes()
        out.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_repeats(spark, edge, empty, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(4)
    rows = [(r[0], r[1] and r[1][:3000]) for r in edge_rows()]
    passages = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(40, 130))) for _ in range(6)]
    for k in range(100, 160):
        parts = [rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(rng.randint(1, 6))]
        rows.append((k, "".join(parts)))
    rows += [(170, "z" * 400), (171, "z" * 120), (172, "y" + "z" * 49)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = repeats.remove_repeats(df).collect()
    assert collections.Counter(tuple(r[n] for n in names) for r in got) == brute_repeats(rows)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)
    assert repeats.remove_repeats(edge).count() == len(edge_rows())
    assert repeats.remove_repeats(empty).count() == 0


# --- 10: shards


def test_sharding(edge, empty, spark, small):
    got = sharding.assign(edge, shards=4).collect()
    rows = edge_rows()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    documents = sharding.assign(spark.read.parquet(f"{small}/documents.parquet"), shards=8).collect()
    for found, shards in ((got, 4), (documents, 8)):
        slots = collections.defaultdict(list)
        for r in found:
            assert r["law"] == "bytes" and 0 <= r["shard"] < shards
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = collections.Counter()
    for r in documents:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 8
    assert max(abs(s - mean) for s in sizes.values()) <= max(r["size"] for r in documents) + 0.01 * mean
    assert sharding.assign(empty).count() == 0


def test_sharding_divides_one_hot_text(spark):
    rows = [(k, "same text for a third of all" if k % 3 else f"text {k} " * (k % 7)) for k in range(600)]
    found = sharding.assign(spark.createDataFrame(rows, "doc_id bigint, text string"), shards=6).collect()
    sizes = collections.Counter()
    for r in found:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) < 0.05 * sum(sizes.values()) / 6


# --- 9: secrets


def brute_base(text):
    letters = lambda w: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join([*map(letters, ("password", "passwd", "secret", "token")), "[aA][pP][iI]_?[kK][eE][yY]"])
    patterns = (
        ("assign", rf"""(?:{names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
        ("access", "AKIA[A-Z0-9]+", 0, 18),
        ("hex", "[0-9a-f]+", 0, 16),
    )
    found = [(m.start(), n, m.end(), kind) for n, (kind, p, g, least) in enumerate(patterns) for m in re.finditer(p, text) if len(m[g]) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_base_secrets_equal_the_patterns():
    rng = random.Random(9)
    bits = ["password", "PassWD", "secret", "toKen", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abcdef012345", "ghijklmnop", "AKIA", "ABCDEF0123456789", "ſ", "K", "é", "\n", "a1b2c3d4e5f6a7b8"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert secrets_scan.joined(secrets_scan.base_spans(text, text.lower())) == brute_base(text)


def test_lexer_propagates_constants():
    value = "Zk93hfJw02mQp7sLx"
    text = f'X = "{value}"\nname = "plain words here"\ndb_password = X\ncount = 12\nauth_token = "abc" + "{value}"\ncolour = "{value}"\n'
    _, spans = secrets_scan.all_spans(text)
    lexed = {text[a:b] for a, b, kind in spans if kind == "lexed"}
    assert lexed == {value, "abc"}
    first = text.index(value)
    assert (first, first + len(value), "lexed") in spans  # reached through X
    assert all(text[a - 10 : a].find("colour") < 0 for a, _, kind in spans if kind == "lexed")


def test_lexing_is_linear_in_runs_of_name_characters():
    value = "qX9vR2mK7pL4wZ8t"
    for run in ("a" * 1_000_000, "a.b-" * 250_000, "1" * 1_000_000, "f0" * 500_000, '"' * 200_000, "'a" * 200_000, "a " * 200_000, " " * 500_000):
        text = f"{run}, password = {value}"
        start = time.perf_counter()
        spans = secrets_scan.lexed_spans(text)
        assert time.perf_counter() - start < 3
        assert [text[a:b] for a, b, _ in spans] == [value], run[:4]


def test_pairs_begin_where_they_did_before():
    rng = random.Random(12)
    plain = secrets_scan._PAIR.pattern.replace("*+", "*")
    free = re.compile(plain[plain.index("(?P<q>") :], re.ASCII)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "b9", "9", ".", "-", "_", '"', "'", "=", ":", " ", ":=", "=>", "==", "é", "\n"]) for _ in range(rng.randint(1, 14))) + "x"
        want = [(m["name"], m.end()) for m in free.finditer(text)]
        assert [(m["name"], m.end()) for m in secrets_scan._PAIR.finditer(text)] == want, text


@pytest.mark.parametrize("word", sorted(secrets_scan.SENSITIVE))
def test_every_listed_name_reports_random_literals(word):
    for value in ("Zk93hfJw02mQp7sLx", "q8Zr+T4vXb1/Yd7KpW3sNf0Lc9GhMj5aUe2Ro6Ti", "x7Kp2VnQ9sWd4RtZ" * 4):
        text = f'my_{word} = "{value}"\n'
        found = {text[a:b] for a, b, kind in secrets_scan.all_spans(text)[1] if kind == "lexed"}
        assert found == {value}
    text = f'my_{word} = "plain"\n'
    assert not secrets_scan.lexed_spans(text)


def test_weak_names_and_phrases():
    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for length in (20, 32, 40, 64):
        values = ["".join(rng.choices(letters, k=length)) for _ in range(300)]
        for name in ("private_key", "encryption_key", "auth", "signature"):
            assert sum(secrets_scan.is_secret(name, v) for v in values) > 0.9 * 300, (name, length)
    for name, value in [("cache_key", "user_profile_list"), ("sort_key", "2024-01-01"), ("auth", "https://example.com/login"), ("dsn", "postgres://localhost/mydatabase"), ("key", "the quick brown fox")]:
        assert not secrets_scan.is_secret(name, value)
    text = 'dsn = "postgres://app:Zx81kQp0vTn4@db/main"\npassphrase = "correct horse battery staple"\n'
    assert {text[a:b] for a, b, _ in secrets_scan.lexed_spans(text)} == {"postgres://app:Zx81kQp0vTn4@db/main", "correct horse battery staple"}


def test_references_before_definitions():
    value = "Zk93hfJw02mQp7sLx"
    for text in (f"PASSWORD=${{VALUE}}\nVALUE={value}\n", f"PASSWORD=$A\nA=$B\nB={value}\n"):
        assert {text[a:b] for a, b, _ in secrets_scan.lexed_spans(text)} == {value}
    assert secrets_scan.lexed_spans("PASSWORD=$A\nA=$B\nB=$A\n") == []


def test_secrets_on_edges(edge, empty):
    assert collections.Counter(r["doc_id"] for r in secrets_scan.scan(edge).collect()) == collections.Counter(r[0] for r in edge_rows())
    assert secrets_scan.scan(empty).count() == 0


# --- 4: pseudonyms


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_pseudonyms(spark):
    values = {
        "card": ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004"],
        "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
        "ssn": ["123-45-6789", "899-99-9999"],
        "phone": ["+1 (456) 555-2186", "212-555-0187"],
        "ip": ["10.0.255.1"],
        "date": ["1999-12-31", "2024-02-29", "7/4/1976", "31.12.1999"],
        "email": ["Jane.Doe42@mail1.example.com"],
    }
    left = ["4111111111111112", "000-12-3456", "666-12-3456", "300.1.1.1", "2023-02-30", "DE88370400440532013000", "no@where"]
    rows = [(k, f"a {v}, b {v}.") for k, v in enumerate(v for group in values.values() for v in group)]
    rows += [(100 + k, f"x {v} y") for k, v in enumerate(left)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    new = by_id(pseudonyms.pseudonymise(df, key="k"))
    back = by_id(pseudonyms.pseudonymise(spark.createDataFrame([(i, r["text"]) for i, r in new.items()], "doc_id bigint, text string"), key="k", decrypt=True))
    number = 0
    for kind, group in values.items():
        for value in group:
            text = new[number]["text"]
            assert new[number][f"n_{kind}"] == 2, (kind, value, text)
            made = text[2 : text.index(", b ")]
            assert made != value and text == f"a {made}, b {made}."
            if value != "7/4/1976":
                assert re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", made.split("@")[0] if kind != "ip" else ""))) == re.sub(
                    "[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", value.split("@")[0] if kind != "ip" else ""))
                )
            if kind == "card":
                assert luhn(re.sub("[ -]", "", made))
            if kind == "date" and "-" in value:
                datetime.date.fromisoformat(made)
            if kind == "iban":
                packed = made.replace(" ", "")
                assert int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1
            # A day or month written with one digit comes back with two.
            assert back[number]["text"] == rows[number][1].replace("7/4/1976", "07/04/1976")
            number += 1
    assert new[0]["text"][2:18] == new[1]["text"][2:21].replace(" ", "")  # one card, two layouts
    for k, value in enumerate(left):
        assert new[100 + k]["text"] == f"x {value} y"


def test_values_beside_other_groups(spark):
    card, amex, iban, other = "4111 1111 1111 1111", "3782 822463 10005", "ES91 2100 0418 4502 0005 1332", "GB29NWBK60161331926819"
    texts = [f"{card} 123", f"{card} 12/26 ok", f"{card}-123", f"123 {card}", f"{amex} {card}", f"{card} 2024-05-01", f"{card} 10.0.0.1 x", f"{card} 123-45-6789",
             f"{iban} EUR", f"{iban} PAID IN FULL", f"{other} EUR.", f"AB12 {iban}", f"{iban} {card}", f"AB12 {card} 123", f"{iban} {other}", card, iban]
    texts += ["7" * 40_000, "1234567 " * 300 + card]
    # 16 digits with a code behind them, and cards of 19 digits: both turn back.
    rng = random.Random(4)
    bodies = ["".join(rng.choices("0123456789", k=k)) for k in (15, 18) for _ in range(60)]
    numbers = [b + next(str(d) for d in range(10) if luhn(b + str(d))) for b in bodies]
    first = len(texts)
    texts += [" ".join(n[k : k + 4] for k in range(0, len(n), 4)) + (" 123" if len(n) == 16 else "") for n in numbers]
    new = pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), key="k").collect()
    got = {r["doc_id"]: r for r in new}
    for i, text in enumerate(texts[:first]):
        if i != 17:
            assert all(value not in got[i]["text"] for value in (card, amex, iban, other, "2024-05-01", "10.0.0.1", "123-45-6789")), (text, got[i])
            assert got[i]["n_card"] == (card in text) + (amex in text) and got[i]["n_iban"] == (iban in text) + (other in text), text
    assert all(got[i]["text"] == got[15]["text"] + tail for i, tail in [(0, " 123"), (1, " 12/26 ok"), (2, "-123")])
    assert all(got[i]["text"] == got[16]["text"] + tail for i, tail in [(8, " EUR"), (9, " PAID IN FULL")])
    assert got[17]["text"] == texts[17] and got[10]["text"].endswith(" EUR.")
    back = pseudonyms.pseudonymise(spark.createDataFrame([(r["doc_id"], r["text"]) for r in new], "doc_id bigint, text string"), key="k", decrypt=True)
    back = {r["doc_id"]: r["text"] for r in back.collect()}
    assert all(got[i]["text"] != texts[i] and back[i] == texts[i] for i in range(first, len(texts)))


def test_pseudonyms_are_a_bijection(spark):
    new = pseudonyms.pseudonymise(spark.range(10_000).selectExpr("id as doc_id", "concat('10.3.', id div 256, '.', id % 256) as text"))
    assert new.select("text").distinct().count() == 10_000


def test_pseudonyms_on_edges(edge, empty):
    got = pseudonyms.pseudonymise(edge)
    assert collections.Counter((r["doc_id"], r["text"]) for r in got.collect()) == collections.Counter((r[0], r[1]) for r in edge_rows())
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert pseudonyms.pseudonymise(empty).count() == 0


# --- 1: decontamination


def edit_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        want = edit_distance(item, text)
        got = decontaminate.edit_within(item, decontaminate.letter_masks(item), text, len(item))
        assert (got[0] if got else len(item)) == want


def test_decontamination_recall(spark, small, documents):
    """Items with up to 15 % of their letters edited, inside other texts; clean texts stay clean."""
    rng = random.Random(8)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = []
    for k in range(240):
        item = items[k % len(items)][1]
        text = list(item)
        for _ in range(int(len(text) * rng.choice([0, 0, 0.02, 0.05, 0.1, 0.15]))):
            spot = rng.randrange(len(text))
            text[spot : spot + 1] = rng.choice([[], ["e"], [text[spot], "n"]])
        rows.append((k, documents[k % 50][1][:300] + " " + "".join(text).upper() + " " + documents[k % 40][1][:200]))
    found = by_id(decontaminate.find_items(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")))
    hit = [items[k % len(items)][0] in {h["item_id"] for h in found[k]["hits"]} for k in range(240)]
    assert sum(hit) >= 0.95 * len(hit)
    scrambled = [(k, " ".join(rng.sample(t.split(), len(t.split())))) for k, (_, t) in enumerate(documents[:80])]
    clean = by_id(decontaminate.find_items(spark.createDataFrame(scrambled, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")))
    assert not any(r["hits"] for r in clean.values())


def test_decontamination_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, ""), (None, "x"), (4, "ünï"), (5, "a b")], "item_id bigint, text string")
    found = decontaminate.find_items(edge, items).collect()
    assert len(found) == len(edge_rows())
    hits = {r["doc_id"]: {h["item_id"] for h in r["hits"]} for r in found}
    assert hits[14] == {1} and hits[11] == {4} and hits[3] == {5} and hits[8] == set()
    assert decontaminate.find_items(empty, items).count() == 0
    none = decontaminate.find_items(edge, items.where("item_id = 99"))
    assert not any(r["hits"] for r in none.collect())


# --- 2: toxicity


def test_automaton_equals_edit_distance():
    rng = random.Random(11)
    terms = ["idiot", "moron", "pathetic", "stup*", "abcab", "cabbagecab"]
    automaton = toxicity.TermAutomaton(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row

    for _ in range(4000):
        word = list(rng.choice([t.rstrip("*") for t in terms]) + rng.choice(["", "", "id", "xyz"]))
        for _ in range(rng.randint(0, 3)):
            spot = rng.randrange(len(word) + 1)
            word[spot : spot + rng.randint(0, 1)] = rng.choice([[], ["a"], ["b"], ["z"]])
        word = "".join(word)
        best = None
        for number, term in enumerate(terms):
            body = term.rstrip("*")
            row = distance(body, word)
            errors = min(row) if term.endswith("*") else row[-1]
            if errors <= (2 if len(body) >= 8 else 1):
                best = min(best or (9, 9), (errors, number))
        got = automaton.find(word)
        assert (got and got[0]) == (best and best[0]), word


def test_toxicity(spark, small, edge, empty):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["water", "stone", "river", "cloud", "light"]) for _ in range(30)) for _ in range(400)]
    rows = [(k, t + (" you absolute " + rng.choice(["snorfle", "snorflung", "idiot", "idoit", "morron"]) if k % 4 == 0 else "")) for k, t in enumerate(texts)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id bigint, toxic int")
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.learn(table, labels)
    got = by_id(toxicity.score(table, model))
    for k in range(400):
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert got[k]["predicted"] == int(k % 4 == 0)
    # Labels of held-out rows change nothing.
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(table, flipped) == model
    assert toxicity.score(edge, model).count() == len(edge_rows())
    assert toxicity.score(empty, model).count() == 0
    untaught = toxicity.learn(docs, labels.where("false"))
    assert by_id(toxicity.score(spark.createDataFrame([(1, "you idiot"), (2, "hello"), (3, None)], "doc_id bigint, text string"), untaught))[1]["predicted"] == 1


def test_quotation_scores_below_abuse():
    scanner = toxicity.Scanner(["idiot"])
    names = toxicity.FEATURES
    abuse = dict(zip(names, scanner.features("you are an idiot and that is all")))
    quote = dict(zip(names, scanner.features('the man said "idiot" and left')))
    assert abuse["exact"] > 0 and abuse["addressed"] > 0 and abuse["quoted"] == 0
    assert quote["quoted"] > 0 and quote["exact"] == 0
