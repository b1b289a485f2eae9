"""Operator 13: URL filters by a sort-merge range join.

Method: the labels of a host are reversed and each is ended by a point (``www.example.net`` becomes
``net.example.www.``), so the hosts that a rule fits, its own and all subdomains, are the keys that
begin with the rule's key: an interval of the sorted order. Addresses and rules meet in that order.
Sampled splitters cut it into ranges; a rule goes to every range that its interval touches, each
address to one, and rows of one key are spread over ranges by a hash, so a host with a third of all rows
fills many. In a range one sweep over the sorted rows keeps a stack of the rules whose intervals
are open; they are nested, as two intervals of prefixes cannot cross. The longest rule (host and
path counted together, the longer host on a tie) on the stack whose path begins the address' path
gives the verdict.

Edge cases: a null address, or one without ``://``, has an empty host and path; no rule fits and the
default verdict holds. Ports and user names are part of the host as given. A null page id passes
through, repeated rows each get a row. Rules without a host or verdict are left out; a null path
counts as empty; of equal rules with two verdicts ``block`` wins. No rules: every row gets the default.
An empty table gives no rows. Only the address is read, whole, whatever its length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewsift.llm import common

#: (host, path, verdict): the registered query's rules.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
DEFAULT = "allow"
#: Keys drawn per range, and characters of a splitter. Any string can split, so cutting it short
#: only makes a border coarser; rows are compared by their whole keys.
DRAWS = 64
SPLITTER = 256

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (
        F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
    )


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each ended by a point; an empty host has the empty key."""
    labels = F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")
    return F.when(host == "", "").otherwise(F.concat(labels, F.lit(".")))


def _place(key: Column, tie: Column) -> Column:
    """What splitters are compared with: the start of the key, then a hash that spreads equal keys."""
    return F.concat(F.substring(key, 1, SPLITTER), F.lit("\x00"), F.lpad(F.hex(F.xxhash64(tie)), 16, "0"))


def _splitters(keyed: DataFrame, ranges: int, draws: int) -> list[str]:
    """Quantiles of a sample of about ``ranges * draws`` places, which the driver reads: short strings,
    as many for any input."""
    total = keyed.count()
    share = min(1.0, ranges * draws / max(total, 1))
    drawn = keyed.select("place").sample(share, seed=13).sort("place")
    places = [row["place"] for row in drawn.toLocalIterator()]
    step = max(1, len(places) // ranges)
    return sorted(set(places[step::step]))


def _dealt(keyed: DataFrame, cuts: list[str]) -> DataFrame:
    """Addresses with the number of their range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = [c.encode() for c in cuts]  # bytes sort as Spark sorts strings
        for batch in batches:
            at = [bisect_right(coded, p.encode()) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns[1:]], names=["range", *batch.schema.names[1:]])

    rest = keyed.drop("place")
    return keyed.select("place", *rest.columns).mapInArrow(run, "range int, " + ", ".join(f"`{n}` {t}" for n, t in rest.dtypes))


def _copied(rules: DataFrame, cuts: list[str]) -> DataFrame:
    """A row for each range that a rule's interval touches; one range more never does harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = [c.split("\x00")[0].encode() for c in cuts]
        for batch in batches:
            at, rows = [], []
            for n, key in enumerate(batch.column(0).to_pylist()):
                least = key[:SPLITTER].encode()
                # The last splitter below the interval opens the first range, the first above it ends the last.
                first = bisect_right(starts, least)
                while first > 0 and starts[first - 1] >= least:
                    first -= 1
                last = first
                while last < len(starts) and (starts[last] <= least or starts[last].startswith(least)):
                    last += 1
                at += range(first, last + 1)
                rows += [n] * (last + 1 - first)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *taken.columns], names=["range", *batch.schema.names])

    return rules.mapInArrow(run, "range int, key string, host string, path string, verdict string")


class Sweep:
    """The open rules at a place of the sorted order: a stack of (key, paths by their text, lengths)."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, dict[str, str], list[int]]] = []

    def move(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, host: str, path: str, verdict: str) -> None:
        self.move(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, host, {}, []))
        _, _, paths, lengths = self.stack[-1]
        if paths.get(path) != "block":
            paths[path] = verdict
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def find(self, path: str) -> tuple[str, str] | None:
        """Longest open rule and its verdict."""
        best, size = None, -1
        for _, host, paths, lengths in reversed(self.stack):
            for n in lengths:
                if n <= len(path) and path[:n] in paths:
                    if len(host) + n > size:
                        best, size = (host + path[:n], paths[path[:n]]), len(host) + n
                    break
        return best


def _swept(rows: DataFrame, id_type: str, default: str) -> DataFrame:
    """Verdicts of rows sorted by (range, key, kind): rules come before the addresses they fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, at, now = Sweep(), None, None
        for batch in batches:
            ranges, keys, kinds, paths, hosts, verdicts = (batch.column(i).to_pylist() for i in range(6))
            taken, found = [], []
            for n, (part, key, kind, path) in enumerate(zip(ranges, keys, kinds, paths)):
                if part != at:
                    sweep, at, now = Sweep(), part, None
                if kind == 0:
                    sweep.open(key, hosts[n], path, verdicts[n])
                    now = None
                    continue
                if key != now:
                    sweep.move(key)
                    now = key
                taken.append(n)
                found.append(sweep.find(path) or (None, default))
            rows = batch.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column(6), rows.column(4), rows.column(3), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return rows.mapInArrow(run, f"page_id {id_type}, host string, path string, rule string, verdict string")


def judge(
    df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT, draws: int = DRAWS
) -> DataFrame:
    """One row per row of ``df``: ``page_id, host, path, rule, verdict``.

    ``rules`` has the columns host, path and verdict (``allow`` or ``block``), in any number.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    urls = df.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    keyed = urls.select("*", host_key(F.col("host")).alias("key"))
    # Rows of one key are spread by what differs between them, and by their place where nothing does.
    tie = F.concat_ws("\x00", F.col("page_id").cast("string"), "path", F.monotonically_increasing_id().cast("string"))
    keyed = keyed.withColumn("place", _place(F.col("key"), tie))
    ranges = common.partitions(df)
    cuts = _splitters(keyed, ranges, draws)
    own = F.translate(F.col("host").cast("string"), _UPPER, _LOWER)
    wanted = rules.where("host <> '' and verdict is not null").select(
        host_key(own).alias("key"), own.alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), "verdict"
    )
    columns = ["range", "key", "kind", "path", "host", "verdict", "page_id"]
    kind = df.schema[id_col].dataType
    opened = _copied(wanted, cuts).select("*", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("page_id"))
    asked = _dealt(keyed, cuts).select("*", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("verdict"))
    met = opened.select(columns).union(asked.select(columns)).repartitionById(len(cuts) + 1, F.col("range"))
    return _swept(met.sortWithinPartitions("range", "key", "kind"), kind.simpleString(), default)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"), rule_table(spark))


ORACLE = """
with rest as (
    select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), split as (
    select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
    from rest
), judged as (
    select page_id, host, path, case
        when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
        when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
        when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
        when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/'
    end as rule from split
)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from judged
"""
