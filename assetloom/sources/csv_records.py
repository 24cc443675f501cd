"""CSV records with quoted line breaks, read by many tasks.

Whether a line begins a record depends on all quotes before it in its file. A line is therefore taken
as a map of two states, outside and inside of quotes, to the state at its end. The maps of
the lines of a file range compose to one map per range, and these give the state at which every
range begins. With it each range cuts its own lines into records; only the parts of
records that cross a range's border are brought together, by file and record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetloom.session import cut

QUOTE, DELIMITER = '"', ","
_OUTSIDE, _INSIDE, _CLOSED = 0, 1, 2


def inside_after(line: Column, inside: bool) -> Column:
    """Whether a line that begins inside (or outside) of quotes ends inside of them.

    A quote opens a value only at its beginning, a doubled quote inside a value is one, and quotes elsewhere are text.
    """
    parts = F.split(line, QUOTE, -1)
    start = F.struct(F.lit(_INSIDE if inside else _OUTSIDE).alias("state"), F.lit(not inside).alias("fresh"))

    def step(held: Column, part: Column) -> Column:
        """The state after the quote that follows this part."""
        state, begins = held["state"], part.endswith(DELIMITER) | (held["fresh"] & (part == ""))
        opened = F.when(begins, _INSIDE).otherwise(_OUTSIDE)
        after = F.when(state == _INSIDE, _CLOSED).when((state == _CLOSED) & (part == ""), _INSIDE).otherwise(opened)
        return F.struct(after.alias("state"), F.lit(False).alias("fresh"))

    quotes = F.slice(parts, 1, F.size(parts) - 1)
    return F.when(line.contains(QUOTE), F.aggregate(quotes, start, step)["state"] == _INSIDE).otherwise(inside)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, at, line, from_outside, from_inside``: the lines in order within each range, and whether they end inside of quotes."""
    text = spark.read.option("lineSep", "\n").text(path)
    line = F.col("value")
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), line.alias("line"),
        inside_after(line, False).alias("from_outside"), inside_after(line, True).alias("from_inside"),
    )


def _turns(batch: pa.RecordBatch) -> list[int]:
    """The places at which the rows of a batch go on to another range, its beginning and its end included."""
    at, file = batch.column("at").to_numpy(), batch.column("file").dictionary_encode().indices.to_numpy()
    return [0, *(np.flatnonzero((at[1:] != at[:-1]) | (file[1:] != file[:-1])) + 1).tolist(), len(at)]


def _states(outside: np.ndarray, inside: np.ndarray, state: bool) -> np.ndarray:
    """The state before each line and after the last one, from the state before the first."""
    fixed, swaps = outside == inside, outside & ~inside
    place = np.arange(len(outside))
    last = np.maximum.accumulate(np.where(fixed, place, -1)) if len(place) else place
    turned = np.cumsum(swaps)
    base = np.where(last >= 0, outside[last], state)
    since = turned - np.where(last >= 0, turned[last], 0)
    return np.concatenate([[state], base ^ (since % 2 == 1)])


def ranges(found: DataFrame) -> DataFrame:
    """``file, at, from_outside, from_inside, broken``: the composed map of each range, and whether one of its lines can end inside of quotes."""
    names = ["file", "at", "from_outside", "from_inside", "broken"]

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[bool]] = {}
        for batch in batches:
            turns = _turns(batch)
            outside, inside = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("from_outside", "from_inside"))
            for lo, hi in zip(turns, turns[1:]):
                if lo < hi:
                    own = held.setdefault((batch.column("file")[lo].as_py(), batch.column("at")[lo].as_py()), [False, True, False])
                    after = [bool(_states(outside[lo:hi], inside[lo:hi], state)[-1]) for state in own[:2]]
                    own[:] = [*after, own[2] or bool(outside[lo:hi].any())]
        rows = [(*key, *own) for key, own in held.items()]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    schema = "file string, at long, from_outside boolean, from_inside boolean, broken boolean"
    return found.select("file", "at", "from_outside", "from_inside").mapInArrow(compose, schema)


def begun(composed: DataFrame) -> DataFrame:
    """``file, at, starts_inside, ends_inside`` of each range; the rows are ranges, not lines."""
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy("file").orderBy("at")
    fixed = F.col("from_outside") == F.col("from_inside")
    marked = composed.withColumns({"fixed": fixed, "turned": F.sum(F.expr("int(from_outside AND NOT from_inside)")).over(through)})
    # The state before a range: the last fixed one before it, turned as often as ranges since then turn it.
    base = F.last(F.when(F.col("fixed"), F.struct("from_outside", "turned")), ignorenulls=True).over(before)
    since = F.coalesce(F.last("turned").over(before), F.lit(0)) - F.coalesce(base["turned"], F.lit(0))
    odd = F.pmod(since, F.lit(2)) == 1
    starts = F.coalesce(base["from_outside"], F.lit(False)) != odd
    named = marked.withColumn("starts_inside", starts)
    return named.select("file", "at", "starts_inside", F.when(F.col("starts_inside"), F.col("from_inside")).otherwise(F.col("from_outside")).alias("ends_inside"))


def _cut_records(found: DataFrame, starts: DataFrame) -> DataFrame:
    """``file, at, part, first, text``: records by range, and for ``part`` 0 to 2 the parts of records that cross borders.

    ``part`` is null for a whole record, 0 for the end of an earlier range's record, 1 for a
    record that goes on in the next range, 2 if the range lies inside of one. ``first`` marks the
    first record of a file.
    """
    names = ["file", "at", "part", "first", "text"]

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, open_lines, head, first = None, False, [], False, False

        def row(part: int | None) -> tuple:
            return (*key, part, first and part in (None, 1), "\n".join(open_lines))

        def written(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            rows, turns = [], _turns(batch)
            outside, inside = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("from_outside", "from_inside"))
            texts = batch.column("line").to_pylist()
            for lo, hi in zip(turns, turns[1:]):
                if lo == hi:
                    continue
                here = batch.column("file")[lo].as_py(), batch.column("at")[lo].as_py()
                if here != key:
                    if open_lines:
                        rows.append(row(2 if head else 1))
                    key, state, open_lines, first = here, batch.column("starts_inside")[lo].as_py(), [], here[1] == 0
                    head = state
                ends = _states(outside[lo:hi], inside[lo:hi], state)[1:].tolist()
                for text, state in zip(texts[lo:hi], ends):
                    open_lines.append(text)
                    if not state:
                        rows.append(row(0 if head else None))
                        open_lines, first, head = [], first and head, False
            yield written(rows)
        if open_lines:
            yield written([row(2 if head else 1)])

    joined = found.join(F.broadcast(starts.select("file", "at", "starts_inside")), ["file", "at"])  # one row per file range
    return joined.mapInArrow(assemble, "file string, at long, part int, first boolean, text string")


def records(spark: SparkSession, path: str) -> DataFrame | None:
    """``text``: the records of CSV files without their headers, or None if no record holds a line break.

    The file's ranges are those of Spark's own text reader. A quote that never closes raises.
    """
    found = lines(spark, path)
    composed = cut(ranges(found), "ranges")
    if composed.where("broken").isEmpty():
        return None
    starts = cut(begun(composed), "ranges")
    last = starts.groupBy("file").agg(F.max_by("ends_inside", "at").alias("open")).where("open").select("file").first()
    if last is not None:
        raise ValueError(f"a quoted value has no end in {last.file}")
    parts = _cut_records(found, starts)
    whole = parts.where("part IS NULL AND NOT first").select("text")
    if starts.where("starts_inside").isEmpty():
        return whole.where("rtrim('\r', text) <> ''")
    crossing = cut(parts.where("part IS NOT NULL"), "parts")
    # A record's parts follow its beginning; within a range the end of one record comes before the beginning of the next.
    order = Window.partitionBy("file").orderBy("at", "part")
    numbered = crossing.withColumn("record", F.sum(F.expr("int(part = 1)")).over(order))
    pieces = F.array_sort(F.collect_list(F.struct("at", "part", "text")))
    mended = numbered.groupBy("file", "record").agg(pieces.alias("pieces"), F.bool_or("first").alias("first"))
    mended = mended.where("NOT first").select(F.array_join("pieces.text", "\n").alias("text"))
    return whole.unionByName(mended).where("rtrim('\r', text) <> ''")
