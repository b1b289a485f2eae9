"""Operator 7: n-gram Jaccard self-join with set-relation skipping.

Links join documents whose sets of word shingles have a Jaccard similarity of at least
``percent``; the result names each document's component. Steps:

1. Equal texts count as one (their digest), so copies never meet in pairs.
2. Tokens (shingles) are ordered by hash. A set puts the first places of its order into the
   index: enough that linked sets share at least ``spare + 1`` of them. Lists are sorted by token
   and, within a list, pairs are skipped by size and by position: the shared tokens of a pair and
   the places of the last one bound its similarity before any set is looked at.
3. A token in more than ``block`` sets is *frequent*; its list is not paired. A pair can be lost
   by that only if both sets have at least ``spare + 1`` frequent tokens in the index
   (*crowded* sets), so only crowded sets are joined again:
4. Set relations. Among crowded sets a few leaders are elected (of each list the set whose tokens
   are in most others) and compared with all crowded sets through a rarest-first prefix, again
   skipping by position. A set that links with a leader inherits the leader's answers: two sets that
   follow the same leader need no comparison, and by the triangle inequality of the Jaccard distance
   a set can only link with a follower if it is close enough to the follower's leader. Where such a set
   is in another component, it or the followers, whichever are fewer, come to lead themselves: eight
   of each surroundings first, then eight times as many in each round, as most fall into a known
   component on the way. It ends when nothing is open; no pair is dropped.
5. Components of all links by star contraction.

Edge cases: a null or blank text has no shingles and is linked with nothing (its component is its
own id); rows with a null id are returned with their shingle count and a null component; repeated
rows each get a row. Ids that repeat are taken to repeat the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewsift.llm import common
from reviewsift.llm.graph import components
from reviewsift.llm.id_filter import keep_likely
from reviewsift.llm.shingles import shingle_sets
from reviewsift.session import materialize

WORDS = 5
PERCENT = 80
#: Sets in a list beyond which its token is frequent.
BLOCK = 16
#: Rounds of elections; sets that follow nobody after them lead themselves.
ROUNDS = 2
#: Sets of one leader's surroundings that come to lead in the first round after the elections, and
#: how many times more in each next one.
FIRST_OPEN = 8
MORE_OPEN = 8


def _share(n: Column | np.ndarray, percent: int):
    """ceil(n * percent / 100) for columns."""
    return F.ceil(n * percent / F.lit(100.0)).cast("int")


def _need(a: Column, b: Column, percent: int) -> Column:
    """Least intersection of linked sets of sizes a and b."""
    return F.ceil((a + b) * percent / F.lit(100.0 + percent) - F.lit(1e-9)).cast("int")


def _spare(n: Column) -> Column:
    return F.floor(n / 20).cast("int")


def _index_rows(df: DataFrame, width: int, percent: int) -> DataFrame:
    """(token, doc_id, n, pos): the indexed places of every set; place 0 of each set is there."""

    def run(batches):
        for batch in common.slices(batches):
            tokens, sizes, taken = [], [], []
            for found in shingle_sets(batch.column(1).to_pylist(), width):
                n = len(found)
                take = min(n, n - -(-n * percent // 100) + 1 + n // 20)
                tokens.append(found[:take])
                sizes.append(n)
                taken.append(take)
            lengths = np.array(taken)
            if not lengths.sum():
                continue
            first = np.cumsum(lengths) - lengths
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(tokens).view(np.int64)),
                    batch.column(0).take(pa.array(np.repeat(np.arange(len(lengths)), lengths))),
                    pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                    pa.array((np.arange(lengths.sum()) - np.repeat(first, lengths)).astype(np.int32)),
                ],
                names=["token", "doc_id", "n", "pos"],
            )

    return df.mapInArrow(run, f"token bigint, doc_id {common.id_type(df)}, n int, pos int")


def _repeated(rows: DataFrame) -> DataFrame:
    """Of rows sorted by token: those whose token stands beside an equal one, and each first place."""

    def run(batches):
        held, matched = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [batch] if held is None else [held, batch]
            rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            token = rows.column(0).to_numpy()
            left = np.zeros(len(token), bool)
            left[0] = matched
            left[1:] = token[1:] == token[:-1]
            keep = left | (rows.column(3).to_numpy() == 0)
            keep[:-1] |= left[1:]
            yield rows.slice(0, len(token) - 1).filter(pa.array(keep[:-1]))
            held, matched = rows.slice(len(token) - 1), bool(keep[-1])
        if held is not None and matched:
            yield held

    return rows.mapInArrow(run, rows.schema)


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(rep, n, tokens): the whole sets of the wanted representatives."""
    near = keep_likely(docs, "doc_id", ids, "rep")
    wanted = near.join(ids, near["doc_id"] == ids["rep"], "left_semi").dropDuplicates(["doc_id"])

    def run(batches):
        for batch in common.slices(batches):
            found = list(shingle_sets(batch.column(1).to_pylist(), width))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in found], pa.int32()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))],
                names=["rep", "n", "tokens"],
            )

    return wanted.mapInArrow(run, f"rep {common.id_type(docs)}, n int, tokens array<bigint>")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, shared) of pairs (a, b) from the whole sets."""
    a = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("shared"))


def _similar(percent: int) -> Column:
    return 100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))


def _prefixes(ordered: DataFrame, percent: int) -> DataFrame:
    """(rep, n, pos, token): the rarest tokens of each set, of which a partner must share one. Those that
    no other set has keep their places, but are not listed."""
    take = F.greatest(F.col("n") - _share(F.col("n"), percent) + 1 - F.col("alone"), F.lit(0))
    listed = F.slice("ordered", F.col("alone") + 1, take)
    return ordered.select("rep", "n", "alone", F.posexplode(listed).alias("at", "token")).select("rep", "n", (F.col("at") + F.col("alone")).alias("pos"), "token")


def _against(leaders: DataFrame, ordered: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Leaders (a) against all crowded sets (b): measured pairs with similarity of at least ``percent``."""
    index = _prefixes(ordered.join(leaders, "rep", "left_semi"), percent).toDF("a", "na", "pa", "token")
    probe = _prefixes(ordered, percent).toDF("b", "nb", "pb", "token")
    # The first token that two sets share leaves them what stands from there on.
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    pairs = (
        index.join(probe, "token")
        .where((F.col("a") != F.col("b")) & (left >= _need(F.col("na"), F.col("nb"), percent)))
        .select("a", "b")
        .distinct()
    )
    return _measured(pairs, sets).where(_similar(percent))


def _distance() -> Column:
    """Jaccard distance of a measured pair."""
    return 1 - F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))


def _elected(tokens: DataFrame, left: DataFrame) -> DataFrame:
    """A leader for each set that is left: of the best-ranked sets of its tokens the most frequent."""
    mine = tokens.join(left, "rep", "left_semi")
    best = mine.groupBy("token").agg(F.max("rank").alias("best")).select("token", F.col("best.rep").alias("leader"))
    votes = mine.join(best, "token").groupBy("rep", "leader").agg(F.count("*").alias("c"))
    return votes.groupBy("rep").agg(F.max_by("leader", F.struct("c", "leader")).alias("leader")).select(F.col("leader").alias("rep")).distinct()


def _open_pairs(measured: DataFrame, leaders: DataFrame, roots: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(leader a, set b) of different components between whose followers and b a link may exist, and the
    followers of each leader.

    Leaders know all their links, so an unknown link joins two other sets. One of them, z, follows its
    nearest elected leader a; the other one, b, then is no further from a than z is, plus the distance
    of a link. All sets that are so near to an elected leader are in ``measured``.
    """
    step = 1 - percent / 100
    others = measured.join(leaders.select(F.col("rep").alias("b")), "b", "left_anti").withColumn("far", _distance())
    homes = others.where(_similar(percent)).groupBy("b").agg(F.min(F.struct("far", "a")).alias("home"))
    followers = homes.select(F.col("home.a").alias("a"), F.col("b").alias("rep"), F.col("home.far").alias("far"))
    reach = followers.groupBy("a").agg(F.max("far").alias("reach"), F.count("*").alias("followers"))
    near = others.where(~_similar(percent)).join(reach, "a").where(F.col("far") <= F.col("reach") + step + 1e-9)
    root_of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    apart = near.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    apart = apart.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    return apart.select("a", "b", "followers"), followers


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, root) after some more links: only the links between components are contracted."""
    ends = [roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab"]
    between = links.join(ends[0], "a", "left").join(ends[1], "b", "left")
    between = between.select(F.coalesce("root_a", "a").alias("u"), F.coalesce("root_b", "b").alias("v")).where("u <> v")
    moved = components(between).withColumnsRenamed({"node": "was", "root": "now"})
    known = roots.join(moved, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root"))
    # Ends that had no component until now.
    new = moved.join(roots, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("root"))
    return materialize(known.union(new))


def _with_crowded(crowded: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Components (node, root) of all links, given those found by lists; crowded sets meet here (step 4)."""
    own = sets.join(crowded, "rep", "left_semi")
    tokens = own.select("rep", "n", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("df"))
    ordered = materialize(
        tokens.join(counts, "token")
        .groupBy("rep", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("sorted"), F.avg("df").alias("central"))
        .select(
            "rep",
            "n",
            F.col("sorted.token").alias("ordered"),
            "central",
            F.size(F.filter("sorted", lambda t: t["df"] == 1)).alias("alone"),
        )
    )
    # A set stands in the middle of its family if its tokens are in many others. Tokens of one set come
    # first in the order and have no vote.
    shared = F.slice("ordered", F.col("alone") + 1, F.col("n"))
    tokens = ordered.select("rep", F.struct("central", "rep").alias("rank"), F.explode(shared).alias("token"))
    # Twice the distance that a link allows: a follower's link and its way to its leader.
    wide = 100 - 2 * (100 - percent)
    left, leaders, measured = crowded, None, None
    for _ in range(ROUNDS):
        new = materialize(_elected(tokens, left))
        found = _against(new, ordered, own, wide)
        measured = materialize(found if measured is None else measured.union(found))
        leaders = materialize(new if leaders is None else leaders.union(new).distinct())
        left = materialize(left.join(leaders.union(measured.where(_similar(percent)).select("b")), "rep", "left_anti"))
    roots = materialize(components(links.union(measured.where(_similar(percent)).select("a", "b"))))
    most = FIRST_OPEN
    while True:
        open_, followers = _open_pairs(measured, leaders, roots, percent)
        open_ = materialize(open_)
        # A link has two sides; the smaller one comes to lead, some sets of a leader in each round.
        sides = open_.groupBy("a").agg(F.count("*").alias("opposite"), F.max("followers").alias("followers"))
        theirs = open_.join(sides.where("opposite <= followers").select("a"), "a").select("a", F.col("b").alias("rep"))
        ours = followers.join(sides.where("opposite > followers").select("a"), "a").select("a", "rep")
        turn = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("rep"), "rep"))
        new = theirs.union(ours).withColumn("turn", turn).where(F.col("turn") <= most).select("rep")
        # What followed nobody after the elections leads itself, in the first round.
        new = materialize((new if left is None else new.union(left)).distinct())
        if new.isEmpty():
            return roots
        # Nobody's home is with these: their links are enough.
        found = _against(new, ordered, own, percent).select("a", "b")
        leaders = materialize(leaders.union(new).distinct())
        roots = _merged(roots, materialize(found))
        most, left = most * MORE_OPEN, None


def components_by_shingles(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT, block: int = BLOCK
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``."""
    docs = common.narrow(df, id_col, text_col)
    named = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    digests = named.select("doc_id", F.sha2("text", 256).alias("digest"))
    reps = materialize(digests.groupBy("digest").agg(F.min("doc_id").alias("rep")))

    n = common.partitions(df)
    rows = _index_rows(named, width, percent).repartition(n, "token").sortWithinPartitions("token")
    rows = materialize(_repeated(rows))
    sizes = rows.where("pos = 0").select("doc_id", "n").distinct()

    own = reps.select(F.col("rep").alias("doc_id"))
    index = materialize(rows.join(own, "doc_id", "left_semi").select("token", F.col("doc_id").alias("rep"), "n", "pos").distinct())
    counts = index.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
    index = index.join(counts, "token")
    frequent = index.where(F.col("sets") > block).groupBy("rep", "n").agg(F.count("*").alias("f"))
    frequent = materialize(frequent)
    least_size = _share(F.col("n"), percent)
    crowded = frequent.where(F.col("f") >= _spare(least_size) + 1).select("rep")

    lists = index.where(F.col("sets") <= block)
    a, b = (lists.select("token", F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}")) for x in "ab")
    met = (
        a.join(b, "token")
        .where((F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
        .groupBy("a", "b", "na", "nb")
        .agg(F.count("*").alias("c"), F.max("pa").alias("qa"), F.max("pb").alias("qb"))
    )
    fa, fb = (frequent.select(F.col("rep").alias(x), F.col("f").alias(f"f{x}")) for x in "ab")
    apart = F.col("na") + F.col("nb") - 2 * _need(F.col("na"), F.col("nb"), percent)
    here = F.col("qa") + 1 - F.coalesce("fa", F.lit(0)) + F.col("qb") + 1 - F.coalesce("fb", F.lit(0)) - 2 * F.col("c")
    pairs = materialize(met.join(fa, "a", "left").join(fb, "b", "left").where(here <= apart).select("a", "b"))

    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(crowded).distinct()
    sets = materialize(_sets(named, materialize(wanted), width))
    links = materialize(_measured(pairs, sets).where(_similar(percent)).select("a", "b"))
    roots = _with_crowded(materialize(crowded), sets, links, percent)

    known = (
        digests.join(reps, "digest")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select("doc_id", "rep", F.coalesce("root", "rep").alias("root"))
        .distinct()
    )
    with_size = known.join(sizes, "doc_id", "left").select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("root")).alias("component_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"))
    out = docs.select("doc_id").join(with_size, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_by_shingles(common.table(spark, sf_dir, "documents"))


ORACLE = """
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
    from documents
), shingles as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
    from words
), sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
    select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), links as (
    select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)
), edges as (select a, b from links union all select b, a from links),
reach(doc_id, root) as (
    select doc_id, doc_id from documents
    union
    select e.b, r.root from reach r join edges e on e.a = r.doc_id where r.root < e.b
)
select d.doc_id, coalesce(any_value(n), 0) as n_shingles, min(root) as component_id
from documents d join reach r on r.doc_id = d.doc_id left join sizes s on s.doc_id = d.doc_id group by d.doc_id
"""
