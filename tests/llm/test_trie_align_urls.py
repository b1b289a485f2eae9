"""Prefix trie, token alignment and URL filters against SQL and brute force, on edge cases and small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("reviewsift.llm")

from reviewsift.llm import align, prefix_trie, url_filters  # noqa: E402
from tools.check_oracle import compare, connect  # noqa: E402


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- 11: prefix trie


def turn_key(row):
    _, turn, role, text = row
    role, text = role or "", text or ""
    item = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
    return (turn is not None, turn or 0), item + len(text.encode()).to_bytes(6, "big")


def trie_by_hand(rows):
    convs = defaultdict(list)
    for row in rows:
        if row[0] is not None:
            convs[row[0]].append(row)
    turns = {c: [(r[2] or "", r[3] or "") for r in sorted(own, key=turn_key)] for c, own in convs.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c >= 0 else -1)
        rebuilt[c] = turns.get(c - rest, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = Counter(n[:-1] for n in members if n)
    saved, leaves = Counter(), Counter()
    for node, held in members.items():
        weight = (len(held) - 1) * (len(node[-1][1].encode()) if node else 0)
        for d in range(len(node) + 1):
            saved[node[:d]] += weight
            leaves[node[:d]] += node not in children
    out = []
    for node, held in members.items():
        ended = ",".join(str(c) for c in sorted(held) if len(rebuilt[c]) == len(node))
        up = min(members[node[:-1]]) if node else None
        out.append((min(held), len(node), up, len(held), children[node], leaves[node], saved[node], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def conversation_rows():
    rng = random.Random(3)
    rows = []
    for c in [*range(60), -3, -5, -9, 1000]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 17, 20])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["u", "a", None]), rng.choice(["x", "yé", "", None])))
    for c in (71, 72):  # long ones that part late
        rows += [(c, i, "u", "same" if i < 150 else f"{c}") for i in range(160)]
    # Many copies of one conversation, a family without its first one, rows without an id, repeated rows.
    rows += [(c, i, "u", f"copy {i}") for c in range(200, 300) for i in range(6)]
    rows += [(403, i, "u", "orphan") for i in range(3)]
    return [*rows, (None, 1, "u", "x"), *rows[:20]]


@pytest.mark.parametrize("width", [8, 3])
def test_trie_equals_brute_force(spark, width):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id bigint, turn bigint, role string, text string, block int, prior string")
    assert rows_of(prefix_trie.trie(df, width)) == trie_by_hand(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], schema)).collect() == []
    alone = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(alone, 1, "u", "x")]
    got = rows_of(prefix_trie.trie(spark.createDataFrame(rows, schema)))
    assert got == trie_by_hand(rows) and len(got) == 1 and got[0][5] == 1


def test_trie_query_equals_sql_and_brute_force(spark, small):
    df = prefix_trie.query(spark, small)
    assert compare(df, connect(small).sql(prefix_trie.ORACLE)) == ""
    table = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert rows_of(df) == trie_by_hand([tuple(r) for r in table.collect()])


def test_members_are_hashed_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_PIECE", 10)
    ends = spark.createDataFrame([(b"k" * 16, i) for i in range(500)] + [(b"l" * 16, 7)], "id binary, conv_id bigint")
    got = {bytes(r["id"]): r["ends_sha256"] for r in prefix_trie._ends_digest(ends.repartition(5)).collect()}
    assert got == {b"k" * 16: hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest(), b"l" * 16: hashlib.sha256(b"7").hexdigest()}


# --- 12: alignment


@pytest.fixture(scope="module")
def pair():
    return align.Pair(*align.default_paths())


def spans(ids, sizes):
    at, out = 0, []
    for i in ids:
        out.append((at, at + int(sizes[i]), i))
        at = out[-1][1]
    return out


def aligned_by_hand(pair, rows):
    """Whole texts, every pair of tokens compared; counts in plain dictionaries."""
    docs = []
    for doc_id, text in rows:
        docs.append((doc_id, None))
        if not text:
            continue
        a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
        whole = (" " + text).encode()
        if b"".join(pair.a_bytes[x] for x in a) != whole or b"".join(pair.b_bytes[x] for x in b) != whole:
            continue
        sa, sb = spans(a, pair.a_sizes), spans(b, pair.b_sizes)
        links, first = [], 0
        for s, e, x in sa:
            while sb[first][1] <= s:
                first += 1
            k = first
            while k < len(sb) and sb[k][0] < e:
                links.append((x, sb[k][2]))
                k += 1
        groups, i, j = [], 0, 0
        for end in sorted({e for _, e, _ in sa} & {e for _, e, _ in sb}):
            left, right = [], []
            while i < len(sa) and sa[i][1] <= end:
                left.append(str(sa[i][2]))
                i += 1
            while j < len(sb) and sb[j][1] <= end:
                right.append(str(sb[j][2]))
                j += 1
            groups.append(f"{','.join(left)}|{','.join(right)}")
        docs[-1] = (doc_id, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter()
    for _, found in docs:
        counts.update(set(found[3]) if found else ())
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, found in docs:
        if found is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, digest = found
            out.append((doc_id, n_a, n_b, n_groups, len(links), sum(counts[k] == best[k[0]] for k in links), sum(counts[k] for k in links), digest))
    return sorted(out, key=str)


def token_rows():
    rng = random.Random(5)
    words = ["alpha", "bêta", "東京", "x" * 50, "<s>", "<unk>", "<|endoftext|>", "<0x41>", "😀", "  ", "\n", "Ωmega", "don't", "٣", "\x00"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    rows += [(200, None), (200, ""), (None, "a b"), (None, None), (3, "a b"), (4, "▁x"), (5, "ﬁn"), (6, " lead"), (7, "trail "), (9, "a  b")]
    long = " ".join(rng.choice(["alpha", "beta", "gamma,", "délta"]) for _ in range(60_000))
    return [*rows, (300, long), (301, "y" * 200_000)]


@pytest.mark.parametrize("hot_pairs", [align.HOT_PAIRS, 50, 0])
def test_alignment_equals_brute_force(spark, pair, hot_pairs):
    rows = token_rows()
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id bigint, text string, row int, codes string")
    got = align.align(df, hot_pairs=hot_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(got) == aligned_by_hand(pair, rows)


def test_alignment_of_no_rows(spark):
    assert align.align(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_alignment_query_equals_brute_force(spark, small, pair):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert rows_of(align.query(spark, small)) == aligned_by_hand(pair, rows)


def test_long_texts_are_cut_where_no_token_crosses(pair):
    rng = random.Random(9)
    words = ["the", "Über", "naïve", "слово", "x1", "a,", "  ", "tail\n", "'s", "123"]
    text = " ".join(rng.choice(words) for _ in range(200_000))
    assert len(pair.parts(text)) > 1 and " ".join(pair.parts(text)) == text
    a, b = pair.encode(text)
    assert a == pair.a.encode(" " + text, add_special_tokens=False).ids and b == pair.b.encode(text)


def test_ranks_give_the_ids_of_the_library(pair, spark, small):
    rng = random.Random(6)
    plain = [chr(c) for c in (*range(0x21, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x180))]
    texts = ["".join(rng.choice([*plain, " ", " ", " ", "\n", "'s", "'ll", "e", "n", "9"]) for _ in range(rng.randint(1, 200))) for _ in range(3000)]
    texts += [" \n \n  a", "a\n\n", "   ", "x" * 256, "<|endoftext|> a", "a  b   c\n \nd "]
    texts += [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect() if r["text"]]
    safe = [t for t in texts if align._SAFE.fullmatch(" " + t)]
    assert len(safe) > 3000
    for text in safe:
        assert pair.a_ids(" " + text) == pair.a.encode(" " + text, add_special_tokens=False).ids
    for odd in ("x" * 257, "a\u00a0b", "a\tb", "a\x1cb", "東京", "٣", "a\r"):
        assert not align._SAFE.fullmatch(odd)


# --- 13: URL filters

_LOW = str.maketrans(url_filters._UPPER, url_filters._LOWER)


def judged_by_hand(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest).group().translate(_LOW)
        path = re.match("[^/?#]*([^?#]*)", rest).group(1)
    best = None
    for own, start, verdict in rules:
        if not own or verdict is None:
            continue
        own, start = own.translate(_LOW), start or ""
        if (host == own or host.endswith("." + own)) and path.startswith(start):
            best = max(best or (-1,), (len(own) + len(start), len(own), verdict == "block", own + start, verdict))
    return (host, path, best[3], best[4]) if best else (host, path, None, url_filters.DEFAULT)


def url_rows():
    rng = random.Random(1)
    labels = ["a", "b", "c", "net", "é", "-x", "a.b", ""]

    def host():
        return ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))

    def path():
        return "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 4)))

    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(60)]
    rules += [("B.Net", "", "block"), ("b.net", "", "allow"), ("", "/", "block"), (None, "/", "block"), ("a", None, "allow"), ("c", "/", None)]
    starts = ["http://", "x://", "HTTP://", "", "://", "a://b://"]
    urls = [(i, rng.choice(starts) + host() + rng.choice(["", ":80", ".", "@u"]) + path() + rng.choice(["", "?q=/", "#f", "?"])) for i in range(2000)]
    urls += [(None, None), (5, ""), (5, "http://"), (7, "http://A.b.NET"), (7, "http://A.b.NET"), (8, "http://a" + ".a" * 5000 + "/" + "b" * 100_000)]
    return [*urls, *[(9, "http://a.b/a") for _ in range(1500)]], rules


@pytest.mark.parametrize("draws", [64, 1])
def test_urls_equal_brute_force(spark, draws):
    urls, rules = url_rows()
    df = spark.createDataFrame([(*u, "k", 1) for u in urls], "page_id bigint, url string, key string, range int")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_filters.judge(df, table, draws=draws)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert rows_of(got) == sorted([(i, *judged_by_hand(u, rules)) for i, u in urls], key=str)


def test_urls_without_rows_or_rules(spark):
    schema = "page_id bigint, url string"
    rules = url_filters.rule_table(spark)
    assert url_filters.judge(spark.createDataFrame([], schema), rules).collect() == []
    one = spark.createDataFrame([(1, "http://a.net/x")], schema)
    assert rows_of(url_filters.judge(one, rules.where("1 = 0"))) == [(1, "a.net", "/x", None, "allow")]
    assert rows_of(url_filters.judge(one, rules.where("1 = 0"), default="block"))[0][4] == "block"


def test_url_query_equals_sql_and_brute_force(spark, small):
    df = url_filters.query(spark, small)
    assert compare(df, connect(small).sql(url_filters.ORACLE)) == ""
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url").collect()
    assert rows_of(df) == sorted([(r["page_id"], *judged_by_hand(r["url"], url_filters.RULES)) for r in pages], key=str)
