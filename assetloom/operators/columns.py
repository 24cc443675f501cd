"""Column shaping: names, flattening, duplicate columns, types, match keys."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.functions.text import dict_literal, match_key
from assetloom.functions.values import normalise_date, to_count, to_long, to_time
from assetloom.session import cut

# Columns typed as whole numbers and as text after each file read.
INT_COLUMNS = ["purchase_id", "asset_type_id", "asset_id", "vendor_id", "product_id", "display_id", "count"]
STR_COLUMNS = ["asset_tag", "serial_number", "uuid", "vendor_name", "product_name"]
INT_COLUMNS_MATCHING = INT_COLUMNS + ["vendor"]
INT_COLUMNS_LINKING = INT_COLUMNS + ["vendor", "purchase_assignment"]
DATE_COLUMNS = ["created_at", "updated_at", "acquisition_date", "warranty_expiry_date"]

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def col(name: str):
    """A column by its literal name (names such as ``memory.1`` hold a dot)."""
    return F.col(f"`{name}`")


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def snake_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(" ", "_").replace("-", "_").lower() for c in df.columns])


def strip_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def once(df: DataFrame, value, out: str) -> DataFrame:
    """Add a column that is computed once; a plain projection would be repeated wherever it is used."""
    return df.select("*", F.explode(F.array(value)).alias(out))


def with_bag(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add the attribute bag of a dict-literal text column as ``map<string,string>``."""
    return once(df, dict_literal(col(column)), out)


def _parsed_once(df: DataFrame, column: str) -> DataFrame:
    """``df`` with its bags as ``_bag`` instead of their text, parsed and written in one pass.

    A table of fewer partitions than cores is spread first.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df.select(F.spark_partition_id()).rdd.getNumPartitions() < cores
    spread = df.repartition(cores) if few else df
    return cut(with_bag(spread, column, "_bag").drop(column), "bags")


def bag_keys(parsed: DataFrame) -> list[str]:
    """The distinct attribute names of all ``_bag`` (one action; the names become columns).

    Where names are not a small vocabulary, use ``bag_rows``, which needs no list of them.
    """
    return sorted(r.k for r in parsed.select(F.explode(F.map_keys("_bag")).alias("k")).distinct().collect())


def bag_rows(df: DataFrame, key: str, column: str = "type_fields") -> DataFrame:
    """The attributes in long form, ``(key, attribute, value)``, for any number of names."""
    return with_bag(df.select(col(key), col(column)), column, "_bag").select(col(key), F.explode("_bag").alias("attribute", "value"))


def flatten_bag(df: DataFrame, column: str = "type_fields", keys: list[str] | None = None) -> DataFrame:
    """One text column per attribute name; the attribute bag itself is dropped.

    The bags are parsed once: names and values come from the same written copy. With given
    ``keys`` there is neither a copy nor an action.
    """
    others = [c for c in df.columns if c != column]
    parsed = _parsed_once(df, column) if keys is None else with_bag(df, column, "_bag")
    keys = bag_keys(parsed) if keys is None else keys
    clash = sorted(set(others) & set(keys))
    if clash:
        raise ValueError(f"attribute names already used as columns: {clash}")
    attributes = [F.try_element_at("_bag", F.lit(k)).alias(k) for k in keys]
    return parsed.select(*[col(c) for c in others], *attributes)


def strip_suffixes(df: DataFrame) -> DataFrame:
    """Drop a trailing ``_<digits>`` from every name; repeats become ``x``, ``x.1``, ``x.2``."""
    seen: dict[str, int] = {}
    names = []
    for name in df.columns:
        base = re.sub(r"_\d+$", "", name)
        n = seen.get(base, 0)
        seen[base] = n + 1
        names.append(base if n == 0 else f"{base}.{n}")
    return df.toDF(*names)


def consolidate(df: DataFrame, base: str, method: str = "sum") -> DataFrame:
    """Fold ``base``, ``base.1``, … into ``base`` by ``sum``, ``max`` or ``first_non_null``.

    ``max`` compares numbers. Columns out of an attribute bag are text; they count as numbers
    if every value of the first one is a number, which takes one small action to find out.
    """
    if method not in ("sum", "max", "first_non_null"):
        raise ValueError(f"unsupported method: {method}")
    pattern = re.compile(rf"^{re.escape(base)}(?:\.\d+)?$")
    names = [c for c in df.columns if pattern.match(c)]
    if len(names) <= 1:
        return df
    cols = [col(c) for c in names]
    if method == "sum":
        total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cols])
        value = F.when(F.coalesce(*cols).isNotNull(), total)
    elif method == "max" and isinstance(df.schema[names[0]].dataType, NUMERIC):
        value = F.greatest(*cols)
    elif method == "max" and df.agg(F.bool_and(cols[0].isNull() | cols[0].cast("string").try_cast("double").isNotNull())).first()[0]:
        value = F.greatest(*[c.cast("string").try_cast("double") for c in cols])
    else:
        value = F.coalesce(*cols)
    if base in names:
        return df.withColumn(base, value).drop(*[c for c in names if c != base])
    return df.withColumn(base, value).drop(*names)


def as_long(df: DataFrame, name: str):
    """The column as a nullable whole number; columns that are integers already are only widened."""
    integral = isinstance(df.schema[name].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return col(name).cast("bigint") if integral else to_long(col(name))


def enforce_types(df: DataFrame, ints: list[str] = INT_COLUMNS, strings: list[str] = STR_COLUMNS) -> DataFrame:
    """Ids to nullable whole numbers (bad values null), the listed texts to strings; nulls stay null."""
    typed = {c: as_long(df, c) for c in ints if c in df.columns}
    typed |= {c: col(c).cast("string") for c in strings if c in df.columns}
    return df.withColumns(typed) if typed else df


def format_dates(df: DataFrame, columns: list[str] = DATE_COLUMNS) -> DataFrame:
    typed = {c: normalise_date(col(c)) for c in columns if c in df.columns}
    return df.withColumns(typed) if typed else df


def name_asset_id(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("id", "asset_id")


def purchase_keys(purchases: DataFrame, typed_count: bool = False) -> DataFrame:
    """Lower-case match keys, the composite text and the stock column of purchase lines."""
    df = strip_names(purchases)
    for target, fallback in (("vendor", "vendor_name"), ("item", "product_name")):
        if target not in df.columns:
            if fallback not in df.columns:
                raise KeyError(f"purchases need {target} or {fallback}; columns are {df.columns}")
            df = df.withColumn(target, col(fallback))
    for needed in ("description", "count"):
        if needed not in df.columns:
            raise KeyError(f"purchases need {needed}; columns are {df.columns}")
    if typed_count:
        df = df.withColumn("count", to_count(F.col("count")))
        if "date" in df.columns:
            df = df.withColumn("date", to_time(F.col("date")))
    return (
        df.withColumn("vendor_lower", match_key(F.col("vendor")))
        .withColumn("item_lower", match_key(F.col("item")))
        .withColumn("description_lower", match_key(F.col("description")))
        .withColumn("composite_index", F.concat_ws(" ", "item_lower", "vendor_lower", "description_lower"))
        .withColumn("remaining_count", F.col("count"))
    )


def asset_keys(assets: DataFrame, typed_dates: bool = False) -> DataFrame:
    df = strip_names(assets)
    if typed_dates:
        df = df.withColumn("created_at", to_time(F.col("created_at")))
    return (
        df.withColumn("vendor_name_lower", match_key(F.col("vendor_name")))
        .withColumn("product_name_lower", match_key(F.col("product_name")))
        .withColumn("description_lower", match_key(F.col("description")))
        .withColumn("composite_index", F.concat_ws(" ", "product_name_lower", "vendor_name_lower", "description_lower"))
    )


def only_category(df: DataFrame, column: str, category: str | None) -> DataFrame:
    return df if category is None else df.where(F.lower(col(column)) == category.lower())


def in_stock(purchases: DataFrame) -> DataFrame:
    return purchases.where(F.col("remaining_count") > 0)
