"""Matching again after changes, from a stored matching instead of from nothing.

Assets choose in order, so nothing that an asset does depends on later ones. The first place in
that order at which a change can matter follows from the stored matching alone:

* an asset that is new, gone or changed matters from its own place on, old or new;
* a purchase that lost stock matters from the first of its holders that it can no longer serve;
* a purchase that is new or gained stock matters from the first asset that would rather have it
  than what it holds: an equal key before any similar text, then the better score, then the
  earlier purchase.

All assets before that place keep what they hold, and the rest is matched with the stock that they leave.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.operators.assign import auto_match
from assetloom.operators.matching import AUTO_THRESHOLD, pair_key
from assetloom.operators.ranking import dense_ids
from assetloom.operators.search import Rule, nearest
from assetloom.session import cut


def _ordered(columns: list[str]) -> Column:
    """A value that sorts as the columns do, nulls last."""
    return F.struct(*[v for k, c in enumerate(columns) for v in (F.col(f"`{c}`").isNull().alias(f"n{k}"), F.col(f"`{c}`").alias(f"v{k}"))])


def _assets(assets: DataFrame, order: tuple[str, ...]) -> DataFrame:
    key = pair_key(F.col("product_name_lower"), F.col("vendor_name_lower"))
    known = assets.select("asset_id", key.alias("key"), F.col("composite_index").alias("text"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)])
    return known.withColumn("place", _ordered([*[f"o{k}" for k in range(len(order))], "asset_id"])).select("asset_id", "key", "text", "place")


def _purchases(purchases: DataFrame, order: tuple[str, ...]) -> DataFrame:
    key = pair_key(F.col("item_lower"), F.col("vendor_lower"))
    cap = F.when(F.col("remaining_count") > 0, F.ceil("remaining_count").cast("bigint")).otherwise(0)
    known = purchases.select(
        "purchase_id", key.alias("key"), F.col("composite_index").alias("text"), cap.alias("cap"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)]
    )
    return known.withColumn("rank", _ordered([*[f"o{k}" for k in range(len(order))], "purchase_id"])).select("purchase_id", "key", "text", "cap", "rank")


def _differs(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [~F.col(f"was.{c}").eqNullSafe(F.col(f"now.{c}")) for c in columns])


def first_affected(
    assets: DataFrame, purchases: DataFrame, assets_before: DataFrame, purchases_before: DataFrame, matches: DataFrame, threshold: float
) -> DataFrame:
    """One row with ``place``, the first place of the asset order that the changes can reach; null if there is none.

    The tables are those of ``_assets`` and ``_purchases``; ``matches`` is the stored matching.
    """
    both = assets_before.alias("was").join(assets.alias("now"), F.col("was.asset_id") == F.col("now.asset_id"), "full_outer")
    changed = both.where(_differs(["asset_id", "key", "text", "place"])).select(F.least("was.place", "now.place").alias("place"))

    lines = purchases_before.alias("was").join(purchases.alias("now"), F.col("was.purchase_id") == F.col("now.purchase_id"), "full_outer")
    other = _differs(["purchase_id", "key", "text", "rank"])
    lines = cut(lines.where(other | _differs(["cap"])).select(
        F.col("was.purchase_id").alias("old"), F.when(other, 0).otherwise(F.col("now.cap")).alias("left"),
        F.col("now.purchase_id").alias("purchase_id"), F.col("now.key").alias("key"), F.col("now.text").alias("text"), F.col("now.rank").alias("rank"),
        ((F.col("now.cap") > 0) & (other | (F.col("now.cap") > F.col("was.cap")))).alias("gained"),
    ), "changes")

    held = cut(
        assets_before.join(matches.select("asset_id", F.col("purchase_id").alias("held"), "kind", "fuzzy_score"), "asset_id", "left")
        .join(purchases_before.select(F.col("purchase_id").alias("held"), F.col("rank").alias("held_rank")), "held", "left"), "held")
    lost = held.join(lines.where("old IS NOT NULL").select(F.col("old").alias("held"), "left"), "held")
    # The holders of a purchase beyond what it has left: dense numbers, less those of the holders before.
    numbered = cut(dense_ids(lost.select("held", "left", "place"), [F.col("held"), F.col("place")], "no", unique=True), "holders")
    begins = numbered.groupBy("held").agg(F.min("no").alias("first"))
    displaced = numbered.join(begins, "held").where(F.col("no") - F.col("first") >= F.col("left")).select("place")

    gained = lines.where("gained").select("purchase_id", "key", "text", "rank")
    earliest = gained.groupBy("key").agg(F.min("rank").alias("rank"))
    same_key = held.join(earliest, "key").where(~F.col("kind").eqNullSafe("exact") | (F.col("rank") < F.col("held_rank"))).select("place")
    similar = held.where(~F.col("kind").eqNullSafe("exact"))
    texts = cut(dense_ids(similar.select("text").distinct(), [F.col("text")], "qid", unique=True), "texts")
    targets = cut(dense_ids(gained.groupBy("text").agg(F.min("rank").alias("rank")), [F.col("rank")], "tid", unique=True), "gained")
    hits = nearest(
        texts.select("qid", F.col("text").alias("qtext")), targets.select("tid", F.col("tid").alias("tpos"), F.col("text").alias("ttext")), Rule(threshold)
    )
    best = hits.join(texts, "qid").join(targets.select("tid", "rank"), "tid").select("text", "score", "rank")
    better = (F.col("held").isNull()) | (F.col("score") > F.col("fuzzy_score")) | ((F.col("score") == F.col("fuzzy_score")) & (F.col("rank") < F.col("held_rank")))
    tempted = similar.join(best, "text").where(better).select("place")
    return changed.union(displaced).union(same_key).union(tempted).agg(F.min("place").alias("place"))


def rematch(
    assets: DataFrame,
    purchases: DataFrame,
    assets_before: DataFrame,
    purchases_before: DataFrame,
    matches: DataFrame,
    asset_order: tuple[str, ...] = ("asset_id",),
    purchase_order: tuple[str, ...] = ("purchase_id",),
    threshold: float = AUTO_THRESHOLD,
) -> DataFrame:
    """What ``auto_match(assets, purchases)`` returns, from ``matches``, what it returned for the tables before.

    Asset and purchase ids are unique and not null. Only the assets from the first place on that a change can reach are matched
    again, with the stock that the others leave; without a change that matters the stored rows come back.
    """
    now, before = cut(_assets(assets, asset_order), "assets"), cut(_assets(assets_before, asset_order), "assets")
    lines, lines_before = cut(_purchases(purchases, purchase_order), "lines"), cut(_purchases(purchases_before, purchase_order), "lines")
    start = cut(first_affected(now, lines, before, lines_before, matches, threshold), "start")  # one row
    late = cut(now.where(F.col("place") >= start.scalar()).select("asset_id"), "late")
    kept = cut(matches.join(now.select("asset_id"), "asset_id", "left_semi").join(late, "asset_id", "left_anti"), "kept")
    if late.isEmpty():
        return kept
    used = kept.groupBy("purchase_id").agg(F.count("*").alias("_used"))
    free = F.greatest(F.ceil("remaining_count").cast("bigint") - F.coalesce("_used", F.lit(0)), F.lit(0))
    stock = purchases.join(used, "purchase_id", "left").withColumn("remaining_count", free).drop("_used")
    again = auto_match(assets.join(late, "asset_id", "left_semi"), stock, asset_order, purchase_order, threshold)
    return kept.unionByName(again)
