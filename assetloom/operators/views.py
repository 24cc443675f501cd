"""Views over the linked entities: labels, lookups and reverse links.

Reverse links are rows, not arrays: one vendor or product may hold a third of
all assets, and an array would put that whole group in one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def asset_labels(assets: DataFrame, asset_product: DataFrame, products: DataFrame) -> DataFrame:
    """``display_id`` and product name of each asset, joined by a space."""
    named = asset_product.join(products.select("product_id", F.col("name").alias("_product")), "product_id")
    labelled = assets.select("asset_id", "display_id").join(named.select("asset_id", "_product"), "asset_id", "left")
    return labelled.select(
        "asset_id", F.concat_ws(" ", F.col("display_id").cast("string"), F.col("_product")).alias("asset")
    )


def through(first: DataFrame, second: DataFrame, via: str, src: str, dst: str) -> DataFrame:
    """A two-hop lookup ``src -> via -> dst`` as distinct rows."""
    return first.join(second, via).select(src, dst).distinct()


def reverse(links: DataFrame, src: str, dst: str) -> DataFrame:
    """The link read backwards: distinct ``(dst, src)`` rows."""
    return links.select(dst, src).distinct()


def reverse_counts(links: DataFrame, src: str, dst: str) -> DataFrame:
    """How many sources point at each target."""
    return reverse(links, src, dst).groupBy(dst).agg(F.count("*").alias("linked"))


def purchase_devices(purchase_serials: DataFrame, devices: DataFrame) -> DataFrame:
    """Purchase lines and devices by the device name a line lists: ``(purchase_id, device_name)``."""
    named = purchase_serials.select("purchase_id", F.explode("serial").alias("device_name"))
    return named.join(devices.select(F.col("name").alias("device_name")), "device_name", "left_semi").select(
        "purchase_id", "device_name"
    ).distinct()
