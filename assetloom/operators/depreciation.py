"""Straight-line depreciation schedules of assets, month by month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def depreciation_schedule(assets: DataFrame, cost: str = "cost", start: str = "date", life_months: str = "useful_life", salvage: str | None = None) -> DataFrame:
    """``assets`` with one row per asset and month of use: ``period, month, depreciation, accumulated, book_value``.

    An asset loses ``cost`` less ``salvage`` (a column, or nothing) evenly over its months of use. The
    month in which it starts counts by its days, and the rest of that month is added behind the last whole one.
    ``accumulated`` is the share of the months so far in whole cents, rounded half up, so that the
    amounts of an asset add up to the cent and the last book value is the salvage value. Null cost, start
    or life, and a life below one month, give no rows; a salvage value above the cost takes nothing off.
    """
    first = F.col(start).cast("date")
    life = F.col(life_months).try_cast("int")
    value = F.col(cost).cast("decimal(18,2)")
    rest = F.least(value, F.coalesce(F.col(salvage).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))) if salvage else F.lit(0).cast("decimal(18,2)")
    dated = assets.where(first.isNotNull() & value.isNotNull() & (life >= 1)).select(
        "*", first.alias("_first"), life.alias("_life"), value.alias("_cost"), rest.alias("_rest"),
        F.explode(F.sequence(F.lit(0), F.when(F.day(first) == 1, life - 1).otherwise(life))).alias("_n"),
    )

    def off(n: Column) -> Column:
        """What has come off after the first ``n`` months of the calendar."""
        days = F.day(F.last_day("_first"))
        used = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("_life") * days, n * days - F.day("_first") + 1))  # in days of the first month
        share = (F.col("_cost") - F.col("_rest")) * used.cast("decimal(10,0)") / (F.col("_life") * days).cast("decimal(10,0)")
        return F.round(share, 2).cast("decimal(18,2)")

    month = F.add_months(F.trunc("_first", "MM"), F.col("_n")).alias("month")
    now, before = off(F.col("_n") + 1), off(F.col("_n"))
    return dated.select(
        *[F.col(f"`{c}`") for c in assets.columns], (F.col("_n") + 1).alias("period"), month, (now - before).alias("depreciation"),
        now.alias("accumulated"), (F.col("_cost") - now).alias("book_value"),
    )
