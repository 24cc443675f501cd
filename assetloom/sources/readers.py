"""Scans: CSV, landed JSON pages and records, key-value maps, mapping text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.functions.text import dict_literal, first_braces
from assetloom.functions.values import to_long
from assetloom.operators.columns import lower_names, snake_names
from assetloom.operators.ranking import dense_ids, running_before
from assetloom.session import cut
from assetloom.sources.csv_records import records
from assetloom.sources.schemas import ENTITIES


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).schema
        return True
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def read_csv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """A required CSV file with a header; a missing path raises.

    Quoted values may hold line breaks. One pass over the quotes tells whether any does: if not, files
    are split as plain lines; if so, their records are cut by many tasks as well (``csv_records``),
    and a quote that never closes raises. ``multi_line=False`` skips the pass and breaks a record at
    any line break. With a schema, columns are matched by header name and columns the file lacks
    are left out. Without one, types are inferred, by one task per file where records hold line breaks.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    header = reader.option("inferSchema", False).option("multiLine", multi_line).csv(path)
    broken = records(spark, path) if multi_line else None
    if schema is None:
        return reader.option("inferSchema", True).option("multiLine", broken is not None).csv(path)
    wanted = {f.name.lower(): f.dataType for f in T.StructType.fromDDL(schema).fields}
    if broken is None:
        values = reader.option("multiLine", False).schema(header.schema).csv(path)
    else:
        ddl = ", ".join(f"`{c.replace('`', '``')}` string" for c in header.columns)
        values = broken.select(F.from_csv(F.regexp_replace("text", "\r$", ""), ddl, {"escape": '"', "multiLine": "true"}).alias("r")).select("r.*")
    return values.select(
        *[
            F.col(f"`{c}`").try_cast(wanted[c.strip().lower()]).alias(c)
            if c.strip().lower() in wanted
            else F.col(f"`{c}`")
            for c in header.columns
        ]
    )


def read_optional_csv(
    spark: SparkSession, path: str | None, schema: str | None = None, multi_line: bool = True
) -> DataFrame | None:
    """A CSV file that may be missing (then ``None``); column names come back in lower case."""
    if not path or not path_exists(spark, path):
        return None
    return lower_names(read_csv(spark, path, schema, multi_line))


def read_entity(spark: SparkSession, name: str, path: str, multi_line: bool = True) -> DataFrame:
    """A stage input by entity name, typed from the schema registry; CSV or Parquet."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return read_csv(spark, path, ENTITIES[name], multi_line)


def read_pages(spark: SparkSession, path: str, record_schema: str, page_pattern: str = r"(\d+)\D*$") -> DataFrame:
    """Landed response pages, one JSON object per file, numbered in the file name.

    The records of a page are under its first list-valued key. Reading stops
    at the first page without records, as a paging client would. A page that
    is not JSON raises.
    """
    pages = (
        spark.read.text(path, wholetext=True)
        .select(
            F.regexp_extract(F.col("_metadata.file_name"), page_pattern, 1).cast("bigint").alias("page"),
            F.from_json("value", "map<string,string>", {"mode": "FAILFAST"}).alias("body"),
        )
    )
    is_list = lambda v: F.ltrim(v).startswith("[")
    first_list = F.try_element_at(F.filter(F.map_values("body"), is_list), F.lit(1))
    records = F.from_json(first_list, f"array<struct<{_ddl_fields(record_schema)}>>")
    pages = pages.select("page", F.coalesce(records, F.array().cast(f"array<struct<{_ddl_fields(record_schema)}>>")).alias("records"))
    first_empty = pages.where(F.size("records") == 0).agg(F.min("page")).scalar()
    return (
        pages.where(first_empty.isNull() | (F.col("page") < first_empty))
        .select("page", F.posexplode("records").alias("row_in_page", "r"))
        .select("page", "row_in_page", "r.*")
    )


def _ddl_fields(schema: str) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema).fields)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Hosted-table records: only ``fields`` is kept, the schema is the union of their keys."""
    return snake_names(spark.read.json(path).select("fields.*"))


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Reuse a Parquet copy when it is complete; otherwise build, write and read it."""
    if not path_exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Characters of payloads that one asset may hold as one value, and that one part holds (or a single longer payload).
VALUE_CHARS = 64 << 20
PART_CHARS = 1 << 20


def attach_subresources(assets: DataFrame, responses: DataFrame, kinds: list[str], key: str = "display_id", most_chars: int = VALUE_CHARS) -> DataFrame:
    """Add one JSON-text column per sub-resource; an asset without a response gets ``null`` text.

    ``responses`` holds ``(key, kind, payload)`` with JSON text as payload. A column lists
    all payloads of the asset and kind as a JSON array, in the order of their texts. Nothing is
    cut: an asset with more than ``most_chars`` characters of one kind raises before its payloads are brought
    together, since they belong in rows (``subresource_parts``).
    """
    wanted = responses.where(F.col("kind").isin(kinds) & F.col("payload").isNotNull())
    large = wanted.groupBy(key, "kind").agg(F.sum(F.length("payload") + 1).alias("chars")).where(F.col("chars") > most_chars).first()
    if large is not None:
        raise ValueError(f"{large.kind} of {key} {large[key]} has {large.chars} characters; read it with subresource_parts")
    listed = [F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("payload")))).alias(k) for k in kinds]
    joined = assets.join(wanted.groupBy(key).agg(*listed), key, "left")
    text = {k: F.when(F.size(k) > 0, F.concat(F.lit("["), F.array_join(k, ","), F.lit("]"))).otherwise("null") for k in kinds}
    return joined.select(*assets.columns, *[value.alias(k) for k, value in text.items()])


def subresource_parts(responses: DataFrame, key: str = "display_id", part_chars: int = PART_CHARS) -> DataFrame:
    """``key, kind, part, n_payloads, payload``: all payloads of every key and kind as JSON arrays of bounded size.

    The payloads of a key and kind stand in the order of their texts, through its parts. A part begins
    where the running length of the payloads passes a multiple of ``part_chars``, so it holds at most that many
    characters more than its last payload, and a key with any number of responses is many rows in
    many tasks. Null payloads are left out.
    """
    rows = responses.where("payload IS NOT NULL").select(key, "kind", "payload")
    numbered = cut(dense_ids(rows, [F.col(key).asc_nulls_first(), F.col("kind").asc_nulls_first(), F.col("payload")], "_no"), "payloads")
    chars = F.length("payload") + 1
    placed = running_before(numbered, [key, "kind"], "_no", chars, "_before", numbered.count())
    parted = placed.withColumn("part", F.floor(F.col("_before") / part_chars))
    pieces = F.array_sort(F.collect_list(F.struct("_no", "payload")))
    grouped = parted.groupBy(key, "kind", "part").agg(F.count("*").alias("n_payloads"), pieces.alias("_pieces"))
    # A long payload may leave multiples without a part; parts are numbered without gaps.
    counted = Window.partitionBy(key, "kind").orderBy("part")
    whole = F.concat(F.lit("["), F.array_join("_pieces.payload", ","), F.lit("]"))
    return grouped.select(key, "kind", F.row_number().over(counted).alias("part"), "n_payloads", whole.alias("payload"))


def read_json_map(spark: SparkSession, path: str, value_type: str = "bigint") -> DataFrame:
    """A JSON object ``{"key": number}`` as rows ``(key, value)``; a missing file gives no rows.

    Lines are split across tasks and the pairs are picked out of each line, so
    an indented map of any size never sits in one task. A null stays a null value.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"key STRING, value {value_type}")
    pair = r'"((?:[^"\\]|\\.)*)"\s*:\s*(?:"?(-?[0-9][0-9.eE+-]*)"?|null)'
    key, value = (F.regexp_extract_all("value", F.lit(pair), F.lit(n)) for n in (1, 2))
    found = spark.read.text(path).select(F.explode(F.arrays_zip(key.alias("k"), value.alias("v"))).alias("p"))
    spelled = F.from_json(F.concat(F.lit('["'), F.col("p.k"), F.lit('"]')), "array<string>")[0]
    number = F.nullif(F.col("p.v"), F.lit(""))
    typed = to_long(number) if value_type in ("bigint", "long") else number.try_cast("double").try_cast(value_type)
    return found.select(F.coalesce(spelled, F.col("p.k")).alias("key"), typed.alias("value"))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """A value mapping as rows ``(raw, canonical)``: one dict literal somewhere in a text file, or one object per line."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    whole = not lines.where(~F.col("value").rlike(r"^\s*\{.*\}\s*$")).isEmpty()
    text = spark.read.text(path, wholetext=True).select(first_braces(F.col("value")).alias("t")) if whole else lines.select(F.col("value").alias("t"))
    return text.select(F.explode(dict_literal(F.col("t"))).alias("raw", "canonical"))
