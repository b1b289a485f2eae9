"""A label checkpoint that a stream fills exactly once (S6 and J4 inside ST1).

A micro-batch is delivered again if its run was lost before the stream noted its end. So each delivery
writes to a folder of its own, and a line in a commit log, which is written last, names the folder that
counts. Readers see only folders of the log; a batch that is in the log already writes nothing. Inside a batch,
rows whose id has a committed label are left out, so a row that arrives again, in another batch or
through another stream, is not labelled twice.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from reviewsift.functions.text import with_review_text
from reviewsift.lexicon import Lexicon, VIETNAMESE
from reviewsift.operators.gold import pending
from reviewsift.operators.rubric import rubric_score
from reviewsift.schemas import CHECKPOINT
from reviewsift.sources.io import latest_labels

_LOG = T.StructType(
    [
        T.StructField("batch", T.StringType()),
        T.StructField("batch_seq", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("folder", T.StringType()),
    ]
)
_FOLDER = T.StructField("folder", T.StringType())


def commit_log(spark: SparkSession, directory: str) -> DataFrame:
    """The committed batches: `batch`, `batch_seq`, `rows`, `folder`; empty before the first one."""
    path = f"{directory}/log"
    if not _exists(spark, path):
        return spark.createDataFrame([], _LOG)
    # Two runs at a time could note a batch twice; one folder of it counts.
    noted = spark.read.schema(_LOG).json(path).where("batch is not null")
    line = F.struct("folder", "batch_seq", "rows")
    return noted.groupBy("batch").agg(F.min(line).alias("l")).select("batch", "l.batch_seq", "l.rows", "l.folder")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def append_once(
    labels: DataFrame,
    directory: str,
    batch: str,
    batch_seq: int,
    before_commit: Callable[[], None] | None = None,
) -> bool:
    """Append the labels of one batch, or do nothing if it is committed; tells which.

    ``before_commit`` runs between the two writes (tests break a run there).
    """
    spark = labels.sparkSession
    if not commit_log(spark, directory).where(F.col("batch") == batch).isEmpty():
        return False
    names = [f.name for f in CHECKPOINT.fields]
    folder = f"{batch}-{uuid.uuid4().hex}"
    path = f"{directory}/data/folder={folder}"
    labels.withColumn("batch_seq", F.lit(batch_seq).cast("long")).select(*names).write.json(path)
    if before_commit is not None:
        before_commit()
    rows = spark.read.schema(CHECKPOINT).json(path).count()
    spark.createDataFrame([(batch, batch_seq, rows, folder)], _LOG).coalesce(1).write.mode("append").json(f"{directory}/log")
    return True


def read_committed(spark: SparkSession, directory: str) -> DataFrame:
    """The labels of all committed batches, the last one per annotation id."""
    if not _exists(spark, f"{directory}/data"):
        return spark.createDataFrame([], CHECKPOINT)
    schema = T.StructType([*CHECKPOINT.fields, _FOLDER])
    lines = spark.read.schema(schema).json(f"{directory}/data")
    known = lines.join(commit_log(spark, directory).select("folder"), "folder", "left_semi")
    return latest_labels(known.where(F.col("annotation_id").isNotNull()).select(*CHECKPOINT.names))


def rubric_labels(rows: DataFrame, lexicon: Lexicon = VIETNAMESE) -> DataFrame:
    """Checkpoint lines of the rubric scorer."""
    scored = rubric_score(with_review_text(rows), lexicon)
    given = set(scored.columns)
    return scored.select(
        *[F.col(f.name).cast(f.dataType) if f.name in given else F.lit(None).cast(f.dataType).alias(f.name) for f in CHECKPOINT.fields if f.name != "batch_seq"]
    )


def label_stream(
    stream: DataFrame,
    directory: str,
    state: str,
    label: Callable[[DataFrame], DataFrame] = rubric_labels,
    before_commit: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Label everything that has arrived and append it to the checkpoint in ``directory``; run again to resume.

    ``state`` is the stream's own folder; its name goes into the batch names, so that two streams can fill
    one checkpoint one after the other. ``label`` turns rows into checkpoint lines.
    """
    source = hashlib.sha256(state.rstrip("/").encode()).hexdigest()[:16]

    def commit(batch: DataFrame, number: int) -> None:
        name = f"{source}-{number}"
        if not commit_log(batch.sparkSession, directory).where(F.col("batch") == name).isEmpty():
            return
        fresh = pending(batch, read_committed(batch.sparkSession, directory))
        hook = None if before_commit is None else lambda: before_commit(number)
        append_once(label(fresh), directory, name, number, hook)

    return stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(commit).start()
