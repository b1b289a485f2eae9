"""Operator 3: exact deduplication by skew-safe combining.

Texts are equal when identical after all white space (blank, controls 9 to 13) is deleted. Of
equal texts the one with most code points stays, then the smallest id.

Method: every grouping is by digest *and* content. Each task first combines its own rows (Spark's
partial aggregation), then salted digest groups are merged, so a group that holds a third of all
rows is spread over ``salts`` tasks, then the winners of the salts, at most ``salts`` rows a
group, are combined globally. The rows find their group again by digest alone; only if a digest
has several contents (never seen with SHA-256) its rows are joined with their contents.

Edge cases: a null text counts as empty, and all empty texts are one group. Rows with a null id
count in the group sizes and lose every tie; if only such rows are longest, ``keep_id`` is null
and they stay. Rows that repeat an id get a row each and stay if their id does. Extra columns are
left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewsift.llm import common
from reviewsift.session import materialize

SALTS = 16
#: The largest id, and more than the distance between two ids (2 ** 65).
_TOP = "9223372036854775807"
_SPAN = "36893488147419103232"


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=sha256) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``digest`` names groups; the default is SHA-256 of the normalised text. Any function of the
    text is right, since contents are compared.
    """
    docs = common.narrow(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    norm = F.translate("text", common.WHITE, "")
    # One number orders the rows of a group: length first, then the smaller id; a null id is last.
    top, span = (F.lit(x).cast("decimal(38,0)") for x in (_TOP, _SPAN))
    back = F.coalesce(top - F.col("doc_id").cast("decimal(38,0)") + 1, F.lit(0).cast("decimal(38,0)"))
    score = (F.length("text").cast("decimal(38,0)") * span + back).cast("decimal(38,0)")
    keyed = docs.select(norm.alias("norm"), score.alias("score"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    keyed = keyed.select(digest(F.col("norm")).alias("digest"), "norm", "score", "salt")

    salted = keyed.groupBy("digest", "norm", "salt").agg(F.max("score").alias("score"), F.count("*").alias("size"))
    groups = salted.groupBy("digest", "norm").agg(F.max("score").alias("score"), F.sum("size").alias("group_size"))
    # Groups under one digest: nearly always one, which needs no content from here on.
    named = materialize(
        groups.groupBy("digest").agg(
            F.count("*").alias("contents"), F.max("score").alias("score"), F.max("group_size").alias("group_size")
        )
    )
    tail = F.pmod(F.col("score"), span)
    keep_id = F.when(tail > 0, (top + 1 - tail).cast("bigint"))

    rows = docs.select("doc_id", digest(norm).alias("digest"), F.sha2(norm, 256).alias("text_sha256"))
    single = rows.join(named.where("contents = 1"), "digest").select("doc_id", keep_id.alias("keep_id"), "group_size", "text_sha256")
    clashing = named.where("contents > 1").select("digest")
    if clashing.isEmpty():
        return _flagged(single)
    contents = docs.select("doc_id", norm.alias("norm")).withColumn("digest", digest(F.col("norm")))
    several = (
        contents.join(clashing, "digest", "left_semi")
        .join(groups.join(clashing, "digest", "left_semi"), ["digest", "norm"])
        .select("doc_id", keep_id.alias("keep_id"), "group_size", F.sha2("norm", 256).alias("text_sha256"))
    )
    return _flagged(single.unionByName(several))


def _flagged(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(common.table(spark, sf_dir, "documents"))


_WHITE_SQL = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"
ORACLE = f"""
with d as (select doc_id, length(coalesce(text, '')) as n, {_WHITE_SQL} as norm from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size,
  doc_id = first_value(doc_id) over w as kept, sha256(norm) as text_sha256
from d window w as (partition by norm order by n desc, doc_id)
"""
