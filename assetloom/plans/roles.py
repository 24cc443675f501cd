"""The driver's tables cast as the pipeline's entities, always whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.operators.columns import asset_keys, purchase_keys
from assetloom.session import tune


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def part_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as an asset, created ``p_size`` days into 2024."""
    return asset_keys(
        table(spark, sf_dir, "part").selectExpr(
            "p_partkey AS asset_id",
            "p_name AS name",
            "p_name AS product_name",
            "p_brand AS vendor_name",
            "p_type AS description",
            "timestampadd(DAY, p_size, TIMESTAMP '2024-01-01 00:00:00') AS created_at",
        )
    )


def part_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a purchase line with stock ``p_size div 10 - 1`` (may be none)."""
    return purchase_keys(
        table(spark, sf_dir, "part").selectExpr(
            "p_partkey AS purchase_id",
            "p_name AS item",
            "p_brand AS vendor",
            "p_type AS description",
            "p_retailprice AS cost",
            "CAST(p_size div 10 - 1 AS BIGINT) AS count",
            "timestampadd(DAY, 50 - p_size, TIMESTAMP '2024-01-01 00:00:00') AS date",
        )
    )


def lineitem_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as assets: supplier, part, customer, nation and region are their dimensions."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_extendedprice AS cost", "l_suppkey AS vendor", "l_partkey AS product"
    )
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey AS user_id")
    customers = table(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "c_nationkey AS department_id")
    nations = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS department_id", "n_regionkey AS asset_type_id")
    return lines.join(orders, "l_orderkey").join(customers, "user_id").join(nations, "department_id")


def dimensions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "departments": table(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "n_name AS name"),
        "vendors": table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS name"),
        "requesters": table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name"),
        "asset_types": table(spark, sf_dir, "region").selectExpr("r_regionkey AS id", "r_name AS name"),
        "products": table(spark, sf_dir, "part").selectExpr(
            "p_partkey AS id", "p_name AS name", "p_brand AS manufacturer", "p_type AS description",
            "concat(p_type, ' ', p_name) AS description_text",
        ),
    }


def customer_headcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as staff; BUILDING customers are the active ones. Customers in debt have no first name."""
    return table(spark, sf_dir, "customer").selectExpr(
        "CASE WHEN c_acctbal >= 0 THEN concat(' ', c_mktsegment, ' ') END AS first_name",
        "concat('  ', c_name) AS last_name",
        "concat(lower(c_name), '@example.org ') AS work_email",
        "CASE WHEN c_mktsegment = 'BUILDING' THEN 'Active' ELSE 'Inactive' END AS status",
        "'Full-Time' AS employee_type",
        "CAST(c_custkey AS STRING) AS title",
        "CAST(NULL AS STRING) AS position_start_date",
        "CAST(c_nationkey AS STRING) AS department",
        "CAST(NULL AS STRING) AS termination_date",
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the assignment log: user = asset, property ``k`` = purchase; an error event unassigns."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("user_id").alias("asset_id"),
        F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").cast("bigint")).alias("purchase_id"),
    )


def event_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the purchases that events point at, with ``p_size`` in stock."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS purchase_id", "p_name AS item", "p_brand AS vendor", "CAST(p_size AS BIGINT) AS count",
        "timestampadd(DAY, p_size, TIMESTAMP '2024-01-01 00:00:00') AS date",
    )


def event_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the assets that events point at."""
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS asset_id", "c_name AS name")


def order_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as linked assets: customer = employee, nation = department, region = type.

    Orders with status P name no purchase, and small orders have no employee yet.
    """
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").selectExpr("c_custkey AS o_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS c_nationkey", "n_regionkey")
    return (
        orders.join(customers, "o_custkey")
        .join(nations, "c_nationkey")
        .selectExpr(
            "o_orderkey AS row_no",
            "o_orderkey div 4 AS asset_id",
            "CASE WHEN o_totalprice >= 20000 THEN o_custkey END AS matched_employee_id",
            "CAST(c_nationkey AS BIGINT) AS department_id",
            "o_custkey AS product_id",
            "CAST(n_regionkey AS BIGINT) AS vendor_id",
            "CAST(c_nationkey AS BIGINT) AS asset_type_id",
            "CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS purchase_assignment",
        )
    )
