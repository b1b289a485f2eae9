"""Operator 11: prefix trie of conversations by ROLLUP over positional turn-id columns.

Method: a turn's id is a digest of role and text with the text's length. The turns of a conversation
stand in blocks of ``width`` positions, one row of ``width`` columns per (conversation, block);
the block's key is the node at which the block before it ended. ``GROUP BY block, prior,
ROLLUP (t0, ...)`` then aggregates all prefixes of all blocks together, and ``grouping_id`` tells
the depth inside the block. A second ROLLUP, over the nodes, sums what hangs below each of them.

The node at a block's end is named by sums of position-dependent digests over all turns before it.
Such sums combine, so running sums name all block ends at once, whatever the length, and a
conversation with a third of all turns is spread over range partitions. Sums that cross blocks
climb the same way: the block ends are themselves positions of a coarser trie with ``width`` times
fewer levels, whose blocks are rolled up again, so a conversation of n turns takes log(n) rollups.

Texts are read once and replaced by ids before the first shuffle. Turns and nodes count as equal
if their digests (128 bits) are; contents are not compared again.

Edge cases: rows without a conversation id are left out; a null role or text is empty; turns with
one number follow in the order of their ids (a null number first), repeated ones all count.
A conversation that is rebuilt without turns is a member of the root and ends there. An empty table
has no conversation and gives no rows. A list of members of any length is hashed as a stream of
packed pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewsift.llm import common
from reviewsift.operators.ordering import with_position, with_running_sums
from reviewsift.session import materialize

#: Positions in a block.
WIDTH = 8
#: Turns of a conversation that one row of a salted join serves.
STRETCH = 4096
#: A parent with more than this share of all nodes as children is sent to every task: at most 1,000.
HOT_SHARE = 0.001
_PIECE = 1 << 20
_LANES = 4
#: Fixed values of the task: conversations borrow from the one whose id is a multiple of FAMILY,
#: the checksum of their id modulo BORROWED_MOST + 1 turns.
FAMILY = 5
BORROWED_MOST = 8


def _name(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def _root() -> Column:
    return F.unhex(F.lit("00" * 16))


def turn_rows(df: DataFrame) -> DataFrame:
    """(conv_id, turn, item): the item is a digest of role and text, then the text's bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    size = F.octet_length(text)
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    return df.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.concat(digest, F.unhex(F.lpad(F.hex(size.cast("long")), 12, "0"))).alias("item")
    )


def _size_of(item: Column) -> Column:
    return F.conv(F.hex(F.substring(item, 17, 6)), 16, 10).cast("long")


def borrowed(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first of its family."""
    return F.crc32(conv_id.cast("string")) % (BORROWED_MOST + 1)


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations with their rebuilt ``length``, rebuilt turns: conv_id, d from 1, length, item)."""
    order = [F.col("turn").asc_nulls_first(), F.col("item")]
    placed = materialize(with_position(turns, order, ["conv_id"], "pos"))
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    first = sizes.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = sizes.withColumn("base", base).withColumn("h", borrowed(F.col("conv_id"))).join(first, "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = materialize(convs.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    # At most BORROWED_MOST rows of a base, and FAMILY conversations that take them.
    lent = placed.where((F.col("pos") < BORROWED_MOST) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), "pos", "item")
    head = convs.join(lent, "base").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("d"), "length", "item")
    # One row per conversation and stretch: no key of the join has more than STRETCH turns.
    shift = convs.select(
        "conv_id", "length", (F.col("taken") - F.col("h") + 1).alias("shift"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"own div {STRETCH}"))).alias("stretch")
    )
    tail = placed.where(F.col("pos") >= borrowed(F.col("conv_id"))).withColumn("stretch", F.expr(f"pos div {STRETCH}"))
    tail = tail.join(shift, ["conv_id", "stretch"]).select("conv_id", (F.col("pos") + F.col("shift")).alias("d"), "length", "item")
    return convs.select("conv_id", "length"), head.union(tail)


def _with_names(turns: DataFrame) -> DataFrame:
    """Adds ``node``: the name of the prefix up to each turn."""
    digest = F.md5(F.concat(F.encode(F.col("d").cast("string"), "UTF-8"), F.lit(b":"), "item"))
    lanes = {f"lane{i}": F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(_LANES)}
    stored = materialize(turns.withColumns({f"own_{n}": v for n, v in lanes.items()}))
    summed = with_running_sums(stored, [F.col("d")], {n: F.col(f"own_{n}") for n in lanes}, ["conv_id"])
    return summed.select("conv_id", "d", "length", "item", _name(*(F.unhex(F.lpad(F.hex(n), 16, "0")) for n in lanes)).alias("node"))


def _columns(width: int) -> list[str]:
    return [f"t{j}" for j in range(width)]


def _blocks(places: DataFrame, width: int) -> DataFrame:
    """One row per (conversation, block): ``conv_id, length, block, prior, t0, ...``.

    ``places`` has ``conv_id, d, length, item, node``. The last column of a block holds the name of the node
    at its end behind the item; that name is also the key of the conversation's next block.
    """
    place = ((F.col("d") - 1) % width).cast("int")
    last = place == width - 1
    cell = F.struct(F.expr(f"(d - 1) div {width}").alias("block"), place.alias("j"), F.when(last, F.concat("item", "node")).otherwise(F.col("item")).alias("t"))
    key = F.struct((F.expr(f"(d - 1) div {width}") + 1).alias("block"), F.lit(-1).alias("j"), F.col("node").alias("t"))
    cells = places.select("conv_id", "length", F.explode(F.when(last, F.array(cell, key)).otherwise(F.array(cell))).alias("c"))
    rows = cells.groupBy("conv_id", "length", "c.block").agg(F.sort_array(F.collect_list(F.struct("c.j", "c.t"))).alias("cells"))
    first = F.when(F.col("cells")[0]["j"] < 0, 1).otherwise(0)
    rows = rows.select("*", F.when(first == 1, F.col("cells")[0]["t"]).otherwise(_root()).alias("prior"), F.slice("cells", first + 1, F.size("cells") - first).alias("own"))
    # A conversation that ends with a block leaves only the key of a block that it has not.
    return rows.where(F.size("own") > 0).select("conv_id", "length", "block", "prior", *[F.get("own", F.lit(j))["t"].alias(t) for j, t in enumerate(_columns(width))])


def _names(width: int, coarse: bool) -> list[Column]:
    """Names of the nodes at levels 0 to ``width`` of a row of positional columns."""
    ending = [F.substring(t, F.octet_length(t) - 15, F.lit(16)) for t in map(F.col, _columns(width))]
    if coarse:
        return [F.col("prior"), *ending]
    inside = [_name(F.col("prior"), *(F.col(t) for t in _columns(width)[:n])) for n in range(1, width)]
    return [F.col("prior"), *inside, ending[-1]]


def _at(level: Column, values: list[Column]) -> Column:
    picked = F.when(level == 0, values[0])
    for n, value in enumerate(values[1:], 1):
        picked = picked.when(level == n, value)
    return picked


def _rollup(rows: DataFrame, width: int, sums: str) -> DataFrame:
    """``sums`` of every prefix of the positional columns: ``block, prior, t0, ..., level`` and the sums.

    Levels at which a row has no position are no prefixes and go; level 0 is the block as a whole.
    """
    columns = ", ".join(_columns(width))
    text = f"select block, prior, {columns}, grouping_id() as gid, {sums} from {{rows}} group by block, prior, rollup ({columns})"
    # grouping_id has a bit for each column that is rolled up.
    rolled = rows.sparkSession.sql(text, rows=rows).withColumn("level", F.lit(width) - F.bit_count("gid"))
    present = _at(F.col("level"), [F.lit(True), *(F.col(t).isNotNull() for t in _columns(width))])
    return rolled.where(present).drop("gid")


def _subtree_sums(valued: DataFrame, places: DataFrame, longest: int, width: int, coarse: bool = False) -> DataFrame:
    """(id, saved, leaves): sums over every node's subtree, its own values included.

    ``valued`` has one row per node: ``block, prior, t0, ..., level, id, saved, leaves``; ``places`` are the
    positions (``d`` from 1 to ``longest``) that it was rolled up from. What hangs below a block's end
    comes from the trie of block ends, each with the total of the block that hangs from it.
    """
    if longest > width:
        totals = valued.groupBy("prior").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
        ends = places.where(F.col("d") % width == 0)
        ends = materialize(ends.select("conv_id", F.expr(f"d div {width}").alias("d"), "length", F.col("node").alias("item"), "node"))
        found = _rollup(_blocks(ends, width), width, "count(*) as n").where("level > 0").drop("n")
        found = found.withColumn("id", _at(F.col("level"), _names(width, True)))
        found = materialize(found.join(totals, found["id"] == totals["prior"], "left").select(found["*"], *(F.coalesce(totals[c], F.lit(0).cast("long")).alias(c) for c in ("saved", "leaves"))))
        below = _subtree_sums(found, ends, longest // width, width, True).toDF("end", "more_saved", "more_leaves")
        full = valued.where(F.col("level") == width).join(below, F.col("id") == F.col("end"), "left")
        full = full.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("saved", "leaves")})
        valued = full.select(valued.columns).union(valued.where(F.col("level") < width))
    summed = _rollup(valued.drop("level", "id"), width, "sum(saved) as saved, sum(leaves) as leaves")
    summed = summed.where("level > 0 or block = 0")
    return materialize(summed.select(_at(F.col("level"), _names(width, coarse)).alias("id"), "saved", "leaves"))


def _ends_digest(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256): digest of the ascending ids of each node's ended conversations, comma-joined.

    Range partitions pack ids to pieces; only the pieces meet, and are hashed one after the other.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now, held, size, seq = None, [], 0, 0

        def piece() -> pa.RecordBatch:
            joined = ",".join(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.binary()), pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([joined], pa.string())], names=["id", "part", "seq", "piece"]
            )

        for batch in batches:
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (node != now or size > _PIECE):
                    yield piece()
                    held, size, seq = [], 0, seq + 1
                now = node
                text = str(conv)
                held.append(text)
                size += len(text) + 1
        if held:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            ids, found = [], []
            for node, piece in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if node != now:
                    if running is not None:
                        ids.append(now)
                        found.append(running.hexdigest())
                    now, running = node, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(found, pa.string())], names=["id", "ends_sha256"])
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([running.hexdigest()])], names=["id", "ends_sha256"])

    ordered = ends.repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id")
    pieces = ordered.mapInArrow(pack, "id binary, part int, seq bigint, piece string")
    dealt = pieces.repartition(common.partitions(ends), "id").sortWithinPartitions("id", "part", "seq")
    return dealt.mapInArrow(digest, "id binary, ends_sha256 string")


def _with_parent(nodes: DataFrame, children: DataFrame, total: int) -> DataFrame:
    """Adds ``parent_conv_id``. Parents of very many nodes, few by their share, go to every task."""
    parents = nodes.select(F.col("id").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    many = children.where(F.col("n_children") > HOT_SHARE * total).select(F.col("parent").alias("up"))
    hot = F.broadcast(parents.join(F.broadcast(many), "up"))
    one = nodes.join(hot, nodes["parent"] == hot["up"]).drop("up")
    rest = nodes.join(F.broadcast(many), nodes["parent"] == many["up"], "left_anti").join(parents, F.col("parent") == F.col("up"), "left").drop("up")
    return one.union(rest.select(one.columns))


def trie(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``."""
    convs, turns = rebuild(turn_rows(df))
    places = materialize(_with_names(turns))
    longest = places.agg(F.max("d")).first()[0] or 0
    columns = _columns(width)
    silent = convs.where("length = 0").select(
        "conv_id", "length", F.lit(0).cast("long").alias("block"), _root().alias("prior"), *[F.lit(None).cast("binary").alias(t) for t in columns]
    )
    blocks = materialize(_blocks(places, width).union(silent))
    names = _names(width, False)
    level = F.col("level")
    nodes = _rollup(blocks, width, "min(conv_id) as conv_id, count(*) as n_convs").where("level > 0 or block = 0")
    size = F.coalesce(_size_of(_at(level, [F.lit(None).cast("binary"), *map(F.col, columns)])), F.lit(0))
    nodes = nodes.select(
        "*",
        _at(level, names).alias("id"),
        _at(level, [F.lit(None).cast("binary"), *names[:-1]]).alias("parent"),
        (F.col("block") * width + level).alias("depth"),
        ((F.col("n_convs") - 1) * size).alias("saved"),
    )
    nodes = materialize(nodes)
    children = materialize(nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")))
    childless = nodes.join(children.select(F.col("parent").alias("id")).withColumn("has", F.lit(True)), "id", "left")
    valued = childless.select("block", "prior", *columns, "level", "id", "saved", F.when(F.col("has"), 0).otherwise(1).cast("long").alias("leaves"))
    sums = _subtree_sums(materialize(valued), places, longest, width)
    held = F.size(F.array_compact(F.array(*columns)))
    ends = blocks.where((F.col("length") == 0) | (F.expr(f"(length - 1) div {width}") == F.col("block"))).select(_at(held, names).alias("id"), "conv_id")
    slim = nodes.select("id", "parent", "conv_id", "depth", "n_convs")
    out = (
        _with_parent(slim, children, nodes.count())
        .join(children.select(F.col("parent").alias("id"), "n_children"), "id", "left")
        .join(sums, "id", "left")
        .join(_ends_digest(ends), "id", "left")
    )
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(common.table(spark, sf_dir, "conversations"))


ORACLE = """
with recursive bits(i, k, c) as (
    select i, 0, i from range(256) t(i)
    union all
    select i, k + 1, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end from bits where k < 8
), crc_table as (select list(c order by i) as crc from bits where k = 8),
checksum(conv_id, digits, c) as (
    select distinct conv_id, conv_id::varchar, 4294967295 from conversations where conv_id is not null
    union all
    select conv_id, digits[2:], xor(crc[(xor(c, ascii(digits)) & 255) + 1], c >> 8) from checksum, crc_table where digits <> ''
), ids as (
    select conv_id, conv_id - conv_id % 5 as base, xor(c, 4294967295) % 9 as h from checksum where digits = ''
), given as (
    select conv_id, turn, strlen(coalesce(text, '')) as bytes,
        sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as item
    from conversations where conv_id is not null
), own as (
    select conv_id, list(item order by turn nulls first, item) as items, list(bytes order by turn nulls first, item) as sizes from given group by conv_id
), rebuilt as (
    select i.conv_id, list_concat(coalesce(b.items[1:h], []), o.items[h + 1:]) as items, list_concat(coalesce(b.sizes[1:h], []), o.sizes[h + 1:]) as sizes
    from ids i join own o on o.conv_id = i.conv_id left join own b on b.conv_id = i.base
), prefixes as (
    select conv_id, d, array_to_string(items[1:d], ',') as id, case when d > 0 then array_to_string(items[1:d - 1], ',') end as parent,
        coalesce(sizes[d], 0) as bytes, d = len(items) as ends, items
    from rebuilt, unnest(range(len(items) + 1)) t(d)
), nodes as (
    select id, min(parent) as parent, min(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * min(bytes) as saved,
        coalesce(string_agg(case when ends then conv_id::varchar end, ',' order by conv_id), '') as ended, any_value(items) as items
    from prefixes group by id
), children as (select parent as id, count(*) as n_children from nodes where parent is not null group by parent),
sums as (
    select array_to_string(items[1:a], ',') as id, sum(saved) as saved, count(*) filter (where id not in (select id from children)) as leaves
    from nodes, unnest(range(depth + 1)) t(a) group by 1
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children, s.leaves as n_leaves,
    s.saved::bigint as saved_tokens, sha256(n.ended) as ends_sha256
from nodes n join sums s using (id) left join children c using (id) left join nodes p on p.id = n.parent
"""
