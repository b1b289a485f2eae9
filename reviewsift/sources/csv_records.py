"""Quoted multi-line CSV read by many tasks per file.

A file splits at line breaks only if it is known which of them stand inside quotes. At the start
of a line a reader is in one of two states: at a record, or inside a quoted field. A range of lines
is a map of these two states, whatever came before it, and maps compose; so one pass finds the map of
every range, running compositions over the ranges (a row each) give the state at its start, and a
second pass cuts all ranges into records at the same time. A record that crosses ranges leaves its pieces to
a small table, where they are put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from reviewsift.session import materialize

#: Quotes are doubled inside quoted fields.
CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
_ROWS = 4096

# A field of a line from its start: unquoted, quoted (also with text behind the quote), or still open.
_PLAIN = re.compile('(?!")[^,]*+')
_QUOTED = re.compile('"(?:[^"]|"")*+(?:"([^,]*+)|$)')
_INSIDE = re.compile('(?:[^"]|"")*+(?:"([^,]*+)|$)')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open behind a line that starts at a record or inside such a field."""
    at, pattern = 0, _INSIDE if inside else None
    while True:
        match = (pattern or (_QUOTED if line.startswith('"', at) else _PLAIN)).match(line, at)
        if match.re is not _PLAIN and match.group(1) is None:
            return True
        at, pattern = match.end(), None
        if at >= len(line):
            return False
        at += 1  # the comma


def _lines(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """(file, start, line): lines in order inside each range of a file."""
    reader = spark.read.option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def _ranges(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The stretches of a batch that belong to one range."""
    starts = batch.column(1).to_numpy()
    files = batch.column(0).dictionary_encode().indices.to_numpy()
    edges = np.flatnonzero((np.diff(starts) != 0) | (np.diff(files) != 0)) + 1
    for first, last in zip([0, *edges], [*edges, batch.num_rows]):
        yield batch.column(0)[first].as_py(), int(starts[first]), batch.slice(first, last - first)


def _maps(lines: DataFrame) -> DataFrame:
    """(file, start, from_record, from_quote, crlf): the state behind each range for both states before
    it, and whether its first line ends with a carriage return."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, crlf = None, [False, True], False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": [at[0]], "start": [at[1]], "from_record": [state[0]], "from_quote": [state[1]], "crlf": [crlf]})

        for batch in batches:
            if not batch.num_rows:
                continue
            for file, start, part in _ranges(batch):
                if (file, start) != at:
                    if at is not None:
                        yield row()
                    at, state = (file, start), [False, True]
                    crlf = part.column(2)[0].as_py().endswith("\r")
                quoted = part.column(2).filter(pc.match_substring(part.column(2), '"'))
                for line in quoted.to_pylist():
                    seen = {s: ends_inside(line, s) for s in set(state)}
                    state = [seen[s] for s in state]
        if at is not None:
            yield row()

    return lines.mapInArrow(run, "file string, start bigint, from_record boolean, from_quote boolean, crlf boolean")


def _states(maps: DataFrame) -> DataFrame:
    """(file, start, inside, crlf): the state at each range's start, from the composed maps before it,
    and how the lines of its file end."""
    order = W.partitionBy("file").orderBy("start")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    resets = F.col("from_record") == F.col("from_quote")
    swaps = F.col("from_record") & ~F.col("from_quote")
    # What counts are the last map that forgets its start, and the swaps behind it.
    marked = maps.withColumn("swapped", F.sum(swaps.cast("int")).over(upto))
    last = F.last(F.when(resets, F.struct("from_record", "swapped")), ignorenulls=True).over(earlier)
    marked = marked.withColumns({"last": last, "before": F.coalesce(F.lag("swapped").over(order), F.lit(0))})
    odd = (F.col("before") - F.coalesce("last.swapped", F.lit(0))) % 2 == 1
    inside = F.coalesce("last.from_record", F.lit(False)) != odd
    # The first line end of a file tells, as in the multi-line reader.
    crlf = F.first("crlf").over(W.partitionBy("file").orderBy("start"))
    return marked.select("file", "start", inside.alias("inside"), crlf.alias("crlf"))


def _cut(lines: DataFrame) -> DataFrame:
    """(file, start, kind, record): whole records and pieces of records that cross ranges.

    ``kind`` is 1 for a whole record, 0 for a file's header, 2 for a piece with which a record
    ends, 3 for one with which it begins (5 for the header's), 4 for one that is neither.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, begun, header, crlf, held = None, False, True, False, False, []
        out: list[list] = [[], [], [], []]

        def joined() -> str:
            text = held[0] if len(held) == 1 else "\n".join(held)
            # Line breaks of the file's kind become plain ones inside quotes.
            return text.replace("\r\n", "\n") if crlf else text

        def put() -> None:
            """A finished record, or the end of one that an earlier range has begun."""
            nonlocal header
            kind = 2 if not begun else 0 if header else 1
            text = joined()
            text = text[:-1] if crlf and text.endswith("\r") else text
            if kind == 2 or text:  # empty lines are no records
                for column, value in zip(out, (at[0], at[1], kind, text)):
                    column.append(value)
                header = False
            held.clear()

        def close() -> None:
            """What is left of a range: the piece of a record that goes on behind it."""
            if held:
                text = joined()
                text = text[:-1] if crlf and text.endswith("\r") else text
                for column, value in zip(out, (at[0], at[1], 4 if not begun else 5 if header else 3, text)):
                    column.append(value)
                held.clear()

        def taken() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string())],
                names=["file", "start", "kind", "record"],
            )
            for column in out:
                column.clear()
            return made

        for batch in batches:
            if not batch.num_rows:
                continue
            for file, start, part in _ranges(batch):
                if (file, start) != at:
                    close()
                    at, inside = (file, start), part.column(3)[0].as_py()
                    begun, header, crlf = not inside, start == 0, part.column(4)[0].as_py()
                for line, quoted in zip(part.column(2).to_pylist(), pc.match_substring(part.column(2), '"').to_pylist()):
                    held.append(line)
                    if quoted:
                        inside = ends_inside(line, inside)
                    if not inside:
                        put()
                        begun = True
                    if len(out[0]) >= _ROWS:
                        yield taken()
        close()
        yield taken()

    return lines.mapInArrow(run, "file string, start bigint, kind int, record string")


def _joined(pieces: DataFrame) -> DataFrame:
    """Records from their pieces: each begins with a piece of kind 3 and ends with one of kind 2, or
    with the file. A header in pieces goes."""
    # In a range the end of an older record stands before the beginning of the next one.
    order = [F.col("start"), F.when(F.col("kind") == 2, 0).otherwise(1)]
    number = F.sum(F.col("kind").isin(3, 5).cast("int")).over(W.partitionBy("file").orderBy(*order))
    grouped = pieces.withColumn("number", number).groupBy("file", "number").agg(
        F.sort_array(F.collect_list(F.struct("start", F.when(F.col("kind") == 2, 0).otherwise(1).alias("o"), "record"))).alias("parts"),
        F.min("start").alias("start"),
        F.max("kind").alias("kind"),
    )
    return grouped.where("kind <> 5").select("file", "start", F.array_join("parts.record", "\n").alias("record"))


def csv_records(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, record): the records of CSV files, without their headers; each file is read by as many
    tasks as it has ranges.

    The first record of a file is its header. A record is one line or several with quoted line breaks, as
    they stand in the file. Empty lines outside quotes are no records.
    """
    lines = _lines(spark, path, glob)
    states = materialize(_states(_maps(lines)))
    # One row per range of a file, as many as the scan has tasks.
    known = F.broadcast(states.withColumnsRenamed({"file": "of", "start": "at"}))
    marked = lines.join(known, (F.col("file") == F.col("of")) & (F.col("start") == F.col("at"))).select("file", "start", "line", "inside", "crlf")
    cut = materialize(_cut(marked))
    whole = cut.where("kind = 1").select("file", "start", "record")
    pieces = cut.where("kind > 1")
    return whole.union(_joined(pieces)).select("file", "start", "record")


def read_csv(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """All columns as strings, as the multi-line reader gives them, and the `_file` of each row."""
    reader = spark.read.options(**CSV_OPTIONS)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    names = reader.csv(path).columns
    return parse_records(csv_records(spark, path, glob), names)


def parse_records(records: DataFrame, names: Sequence[str]) -> DataFrame:
    fields = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    options = {k: str(v) for k, v in CSV_OPTIONS.items() if k != "header"}
    return records.select(F.col("file").alias("_file"), F.from_csv("record", fields, options).alias("r")).select("_file", "r.*")
