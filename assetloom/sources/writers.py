"""Sinks: CSV with and without the legacy float format, merged appends, maps, mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.functions.values import whole_text


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; values keep their line breaks and their white space at both ends."""
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).option("header", True).option("escape", '"').options(**kept).csv(path)


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]


def whole_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each float column, whether every value is there and whole."""
    tests = [F.bool_and(F.coalesce((F.col(c) % 1 == 0) & ~F.isnan(c), F.lit(False))).alias(c) for c in columns]
    return df.agg(*tests)


def legacy_floats(df: DataFrame) -> DataFrame:
    """Whole float columns become integers; other float columns lose their decimals as text."""
    columns = float_columns(df)
    if not columns:
        return df
    whole = whole_columns(df, columns).first().asDict()
    return df.withColumns(
        {c: F.col(c).cast("bigint") if whole[c] or whole[c] is None else whole_text(F.col(c)) for c in columns}
    )


def write_clean_csv(df: DataFrame, path: str, legacy_format: bool = False) -> None:
    write_csv(legacy_floats(df) if legacy_format else df, path)


def merge_append(existing: DataFrame | None, new: DataFrame | None) -> DataFrame | None:
    """Existing and new rows by column name, fully equal rows once; one of the two alone stays as it is."""
    if new is None or existing is None:
        return existing if new is None else new
    return existing.unionByName(new, allowMissingColumns=True).dropDuplicates()


def last_per_key(entries: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return entries.groupBy(key).agg(F.max_by(value, order).alias(value))


def write_json_map(entries: DataFrame, path: str, key: str, value: str) -> None:
    """One ``{"key": value}`` object per line, written in parallel; keys must be unique."""
    entries.select(F.to_json(F.create_map(F.col(key).cast("string"), F.col(value))).alias("value")).write.mode(
        "overwrite"
    ).text(path)


def write_mapping(mapping: DataFrame, path: str) -> None:
    """One ``{"raw": "canonical"}`` object per line, as ``read_mapping`` takes it; rows without a canonical value map nothing and are left out."""
    write_json_map(mapping.where("canonical IS NOT NULL"), path, "raw", "canonical")
