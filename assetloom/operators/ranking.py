"""Dense ids and running totals that never put a whole table or a hot group in one task."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.session import cut

# Equal rows are numbered in blocks of this many, so one block is one bounded expansion.
COPIES_PER_BLOCK = 65_536


def dense_ids(df: DataFrame, order_by: list[Column], id_col: str, unique: bool = False) -> DataFrame:
    """Number the rows 1..n in the given order; all remaining columns break ties.

    Wholly equal rows are collapsed to a count before the shuffle and expanded
    at the end; say ``unique`` when ``order_by`` is known to leave no ties. The
    rows are range-partitioned once and written with their range number; the
    only global step is a running sum over one count per range.
    """
    columns = df.columns
    if unique:
        ordered, order = df, order_by
    else:
        counted = df.groupBy(*columns).agg(F.count("*").alias("_copies"))
        last_block = F.floor((F.col("_copies") - 1) / COPIES_PER_BLOCK)
        ordered = counted.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last_block))).withColumn(
            "_copies",
            F.least(F.lit(COPIES_PER_BLOCK), F.col("_copies") - F.col("_block") * COPIES_PER_BLOCK).cast("bigint"),
        )
        order = [*order_by, *[F.col(f"`{c}`").asc_nulls_last() for c in columns], F.col("_block").asc()]
    # Places within a range are counted in the stage that sorts it, so the rows are shuffled once.
    ranged = ordered.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = ranged.withColumn("_range", F.shiftright("_id", 33).cast("int"))
    if unique:
        ranged = cut(ranged.withColumn("_before", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id"), "ranges")
        offsets = _offsets(ranged.groupBy("_range").agg(F.count("*").alias("_total")))
        number = (F.col("_offset") + F.col("_before") + 1).cast("bigint").alias(id_col)
    else:
        running = ranged.drop("_id").withColumn("_before", F.lit(0).cast("bigint"))
        ranged = cut(running.mapInArrow(_running_sum, running.schema), "ranges")
        offsets = _offsets(ranged.groupBy("_range").agg(F.sum("_copies").alias("_total")))
        first = F.col("_offset") + F.col("_before") + 1
        number = F.explode(F.sequence(first, first + F.col("_copies") - 1)).alias(id_col)
    return ranged.join(F.broadcast(offsets), "_range").select(number, *[F.col(f"`{c}`") for c in columns])


def _running_sum(batches):
    """Fill ``_before`` with the copies on the rows before, within one task."""
    total = 0
    for batch in batches:
        copies = batch.column("_copies").to_numpy()
        before = total + np.cumsum(copies) - copies
        total += int(copies.sum())
        place = batch.schema.get_field_index("_before")
        yield batch.set_column(place, batch.schema.field(place), pa.array(before, pa.int64()))


def _offsets(totals: DataFrame) -> DataFrame:
    """Rows before each range. One row per range, so the window and the later broadcast are bounded."""
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))


# Up to this many rows per group (checked by the caller's bound), one sort holds a group.
PLAIN_WINDOW_ROWS = 1_000_000


def cell_width(n: int) -> int:
    """Positions per cell: the number of cells and the rows in a cell both stay near sqrt(n)."""
    return max(1024, math.isqrt(max(n, 1)))


def running_before(
    df: DataFrame, group: list[str], position: str, value: Column, out: str, bound: int, levels: list[str] = ()
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of each group, by ``levels`` and then ``position``.

    ``position`` is a dense number in 1..bound, unique within group and level.
    When ``bound`` rules out large groups, a plain window does. Otherwise
    values are summed per cell of positions first, so a hot group is spread
    over its cells: no task sorts more than one cell, or one group's cells.
    """
    levels = list(levels)
    past = Window.unboundedPreceding, -1
    if bound <= PLAIN_WINDOW_ROWS:
        in_group = Window.partitionBy(*group).orderBy(*levels, position).rowsBetween(*past)
        return df.withColumn(out, F.coalesce(F.sum(value).over(in_group), F.lit(0)).cast("bigint"))
    cells = [*group, *levels, "_cell"]
    celled = cut(df.withColumns({"_cell": F.floor(F.col(position) / cell_width(bound)), "_value": value}), "cells")
    by_cell = Window.partitionBy(*group).orderBy(*levels, "_cell").rowsBetween(*past)
    offsets = (
        celled.groupBy(*cells)
        .agg(F.sum("_value").alias("_sum"))
        .select(*cells, F.coalesce(F.sum("_sum").over(by_cell), F.lit(0)).alias("_offset"))
    )
    in_cell = Window.partitionBy(*cells).orderBy(position).rowsBetween(*past)
    return (
        celled.withColumn("_in_cell", F.coalesce(F.sum("_value").over(in_cell), F.lit(0)))
        .join(offsets, cells)
        .withColumn(out, (F.col("_offset") + F.col("_in_cell")).cast("bigint"))
        .select(*df.columns, out)
    )


def over_group(df: DataFrame, group: list[str], total: Column, out: str, bound: int) -> DataFrame:
    """An aggregate of the whole group on every row of it; ``bound`` as in ``running_before``."""
    if bound <= PLAIN_WINDOW_ROWS:
        return df.withColumn(out, total.over(Window.partitionBy(*group)).cast("bigint"))
    return df.join(df.groupBy(*group).agg(total.cast("bigint").alias(out)), group)
