"""Matching assets to purchase lines: exact keys, similar texts, ranked candidates, work queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.functions.values import date_text
from assetloom.operators.columns import in_stock
from assetloom.operators.ranking import dense_ids
from assetloom.operators.search import EXACT, Rule, nearest
from assetloom.session import cut

# Score thresholds of the automatic and the interactive path.
AUTO_THRESHOLD = 50.0
REVIEW_THRESHOLD = 45.0


def pair_key(first: Column, second: Column) -> Column:
    """Two texts as one unambiguous key (the length of the first leads)."""
    return F.concat(first, F.lit("\u0001"), second, F.lit("\u0001"), F.length(first).cast("string"))


def exact_match(assets: DataFrame, purchases: DataFrame) -> DataFrame:
    """The first in-stock purchase with the asset's vendor and product: ``(asset_id, purchase_id)``."""
    first = in_stock(purchases).groupBy(
        F.col("vendor_lower").alias("vendor_name_lower"), F.col("item_lower").alias("product_name_lower")
    ).agg(F.min("purchase_id").alias("purchase_id"))
    return assets.join(first, ["vendor_name_lower", "product_name_lower"]).select("asset_id", "purchase_id")


def fuzzy_match(assets: DataFrame, purchases: DataFrame, threshold: float = AUTO_THRESHOLD) -> DataFrame:
    """The in-stock purchase whose composite text is most similar: ``(asset_id, purchase_id, fuzzy_score)``.

    Equal texts on either side are searched once; among equal scores the first
    purchase wins. Stock is not consumed here.
    """
    texts = assets.groupBy("composite_index").agg(F.min("asset_id").alias("qid"))
    lines = in_stock(purchases).groupBy("composite_index").agg(F.min("purchase_id").alias("tid"))
    hits = nearest(
        texts.select("qid", F.col("composite_index").alias("qtext")),
        lines.select("tid", F.col("tid").alias("tpos"), F.col("composite_index").alias("ttext")),
        Rule(threshold),
    )
    best = texts.join(hits, "qid").select("composite_index", F.col("tid").alias("purchase_id"), F.col("score").alias("fuzzy_score"))
    return assets.select("asset_id", "composite_index").join(best, "composite_index").drop("composite_index")


def first_match(assets: DataFrame, purchases: DataFrame, threshold: float = AUTO_THRESHOLD) -> DataFrame:
    """Exact match if there is one, else the fuzzy match; only assets that need it are scored."""
    exact = exact_match(assets, purchases)
    rest = assets.join(exact, "asset_id", "left_anti")
    fuzzy = fuzzy_match(rest, purchases, threshold)
    return exact.withColumn("fuzzy_score", F.lit(None).cast("double")).unionByName(fuzzy)


def rank_candidates(
    assets: DataFrame,
    purchases: DataFrame,
    page_size: int,
    page: int = 0,
    threshold: float = REVIEW_THRESHOLD,
    after: DataFrame | None = None,
) -> DataFrame:
    """One page of every asset's candidate list, as a reviewer sees it.

    Exact candidates (same vendor and product) come first by day gap, then the
    others scoring above ``threshold`` by score and day gap, equal ones by purchase;
    a purchase must be in stock and not later than the asset. Page 0 holds ranks
    1..page_size; the next page continues the same list without end. ``after`` is
    the page before, as this function returned it: the search then goes on behind
    its last rows instead of finding the earlier pages again (``page`` counts from it).
    Assets with the same texts and date are searched once; a row whose id repeats
    has a list of its own.
    """
    query_key = pair_key(F.col("product_name_lower"), F.col("vendor_name_lower"))
    asked = assets.where(F.col("created_at").isNotNull()).select(
        "asset_id", F.col("composite_index").alias("qtext"), query_key.alias("q_key"), F.unix_micros("created_at").alias("q_at")
    )
    same = ["qtext", "q_key", "q_at"]
    if after is not None:
        score = F.when(F.col("kind") == "exact", F.lit(EXACT)).otherwise(F.col("fuzzy_score"))
        end = F.max_by(F.struct(score.alias("q_score"), F.col("date_discrepancy").alias("q_gap"), F.col("purchase_id").alias("q_pos"), "rank"), "rank")
        asked = asked.join(after.groupBy("asset_id").agg(end.alias("end")), "asset_id").select("asset_id", *same, "end.*")
        same = [*same, "q_score", "q_gap", "q_pos", "rank"]
    queries = cut(dense_ids(asked.select(*same).distinct(), [F.col(c) for c in same], "qid", unique=True), "asked")
    targets = in_stock(purchases).where(F.col("date").isNotNull()).select(
        F.col("purchase_id").alias("tid"),
        F.col("purchase_id").alias("tpos"),
        F.col("composite_index").alias("ttext"),
        pair_key(F.col("item_lower"), F.col("vendor_lower")).alias("t_key"),
        F.unix_micros("date").alias("t_at"),
    )
    hits = nearest(queries.drop("rank"), targets, Rule(threshold, rounded=True, keyed=True), (page + 1) * page_size)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("gap"), F.asc("tpos"))
    exact = F.col("score") == EXACT
    earlier = F.col("rank") if after is not None else F.lit(0)
    listed = hits.withColumn("_place", F.row_number().over(order)).where(F.col("_place") > page * page_size)
    return (
        asked.join(queries, same).join(listed, "qid")
        .select(
            "asset_id",
            F.col("tid").alias("purchase_id"),
            F.when(exact, F.lit("exact")).otherwise(F.lit("fuzzy")).alias("kind"),
            F.when(~exact, F.col("score")).alias("fuzzy_score"),
            F.col("gap").alias("date_discrepancy"),
            (earlier + F.col("_place")).cast("bigint").alias("rank"),
        )
    )


def candidate_display(candidates: DataFrame, purchases: DataFrame) -> DataFrame:
    """Candidates with the purchase columns a reviewer sees, all as text."""
    shown = candidates.join(purchases.select("purchase_id", "date", "vendor", "item", "cost", "remaining_count"), "purchase_id")
    texts = ["purchase_id", "vendor", "item", "cost", "remaining_count", "fuzzy_score", "date_discrepancy"]
    return shown.select(
        "asset_id", "rank", "kind", date_text(F.col("date")).alias("date"), *[F.col(c).cast("string").alias(c) for c in texts]
    )


def has_exact(assets: DataFrame, purchases: DataFrame) -> DataFrame:
    """``(asset_id, has_exact)``: does an exact candidate exist. Only the first date per key is needed."""
    first = in_stock(purchases).groupBy(
        F.col("vendor_lower").alias("vendor_name_lower"), F.col("item_lower").alias("product_name_lower")
    ).agg(F.min("date").alias("_first"))
    joined = assets.join(first, ["vendor_name_lower", "product_name_lower"], "left")
    return joined.select(
        "asset_id", F.coalesce(F.col("_first") <= F.col("created_at"), F.lit(False)).alias("has_exact")
    )


def work_queue(assets: DataFrame, purchases: DataFrame, order: str = "asset_id") -> DataFrame:
    """Review order: assets with an exact candidate first, then the rest, each in ``order``.

    Adds the previous and next asset. Places are dense ids, so the neighbours
    come from an equi join on place plus or minus one.
    """
    flagged = has_exact(assets, purchases).join(assets.select("asset_id", F.col(order).alias("_order")), "asset_id")
    placed = dense_ids(flagged, [F.col("has_exact").desc(), F.col("_order").asc_nulls_last()], "place")
    near = placed.select("place", F.col("asset_id").alias("neighbour"))
    before = near.select((F.col("place") + 1).alias("place"), F.col("neighbour").alias("previous_asset"))
    after = near.select((F.col("place") - 1).alias("place"), F.col("neighbour").alias("next_asset"))
    return (
        placed.drop("_order").join(before, "place", "left").join(after, "place", "left")
    ).select("place", "asset_id", "has_exact", "previous_asset", "next_asset")
