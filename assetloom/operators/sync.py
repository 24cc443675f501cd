"""Entity upserts and link tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.functions.text import address_line
from assetloom.functions.values import before_dot, id_text, iso_to_utc_date
from assetloom.operators.columns import as_long

def asset_type_fields() -> dict[str, Column]:
    return {"name": F.col("name"), "asset_type_id": F.col("id").cast("string"), "note": F.col("description")}


def asset_fields() -> dict[str, Column]:
    return {
        "asset_id": F.col("asset_id").cast("string"),
        "name": F.col("name"),
        "cost": F.col("cost").cast("double"),
        "description": F.col("description"),
        "serial_number": F.col("serial_number"),
        "acquisition_date": iso_to_utc_date(F.col("acquisition_date")),
        "created_at": iso_to_utc_date(F.col("created_at")),
        "assigned_on": iso_to_utc_date(F.col("assigned_on")),
        "asset_state": F.col("asset_state"),
        "display_id": F.col("display_id").cast("string"),
    }


def department_fields() -> dict[str, Column]:
    return {"name": F.col("name"), "department_id": F.col("id").cast("string")}


def employee_fields() -> dict[str, Column]:
    return {
        "employee_id": F.col("employee_id").cast("string"),
        "first_name": F.col("first_name"),
        "last_name": F.col("last_name"),
        "work_email": F.col("work_email"),
        "status": F.col("status"),
        "employee_type": F.col("employee_type"),
        "title": F.col("title"),
        "position_start_date": F.col("position_start_date"),
        "termination_date": F.col("termination_date"),
    }


def product_fields() -> dict[str, Column]:
    return {
        "name": F.col("name"),
        "product_id": F.col("id").cast("string"),
        "manufacturer": F.col("manufacturer"),
        "description": F.col("description_text"),
    }


def purchase_fields() -> dict[str, Column]:
    return {
        "purchase_id": F.col("purchase_id").cast("string"),
        "reference": F.col("reference"),
        "date": iso_to_utc_date(F.col("date")),
        "cost": F.col("cost").cast("double"),
        "description": F.col("description"),
        "count": F.col("count").cast("bigint"),
        "note": F.col("note"),
        "item": F.col("item"),
    }


def vendor_fields() -> dict[str, Column]:
    texts = {
        "name": F.col("name"),
        "vendor_id": F.col("id").cast("string"),
        "contact_name": F.col("contact_name"),
        "email": F.col("email"),
        "mobile": F.col("mobile"),
        "address": address_line(F.col("address")),
    }
    return {name: F.nullif(value, F.lit("")) for name, value in texts.items()}


# Entity to (its key column, its fields, whether a null clears the stored value).
ENTITY_FIELDS = {
    "asset_types": ("asset_type_id", asset_type_fields, True),
    "assets": ("asset_id", asset_fields, False),
    "departments": ("department_id", department_fields, False),
    "employees": ("employee_id", employee_fields, False),
    "products": ("product_id", product_fields, False),
    "purchases": ("purchase_id", purchase_fields, False),
    "vendors": ("vendor_id", vendor_fields, False),
}


def collapse(source: DataFrame, key: str, order: str, clear_nulls: bool = False) -> DataFrame:
    """One row per key: the last non-null value of each column, or the whole last row."""
    columns = [c for c in source.columns if c not in (key, order)]
    if clear_nulls:
        last = F.max_by(F.struct(*columns), order).alias("_last")
        return source.groupBy(key).agg(last).select(key, "_last.*")
    lasts = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return source.groupBy(key).agg(*lasts)


def upsert(
    target: DataFrame | None,
    source: DataFrame,
    key: str,
    order: str,
    clear_nulls: bool = False,
    record: str | None = None,
) -> DataFrame:
    """Patch the target row of each source key, insert keys the target lacks.

    A null in the source never clears a stored value unless ``clear_nulls``.
    If the target may hold a key twice, ``record`` names its unique record
    number and only the first record of the key is patched. The target's
    columns that the source lacks are kept.
    """
    fresh = collapse(source.where(F.col(key).isNotNull()), key, order, clear_nulls)
    if target is None:
        return fresh
    patch_columns = [c for c in fresh.columns if c != key]
    patch = fresh.select(F.col(key).alias("_key"), F.struct(F.lit(True).alias("_hit"), *patch_columns).alias("_patch"))
    joined = target.withColumn("_stored", F.lit(True)).join(patch, F.col(key) == F.col("_key"), "full_outer")
    hit = F.col("_patch").isNotNull()
    if record is not None:
        # Rows without a key are patched by nothing; each is a group of its own.
        first = F.min(record).over(Window.partitionBy(key, F.when(F.col(key).isNull(), F.col(record))))
        hit = hit & (F.col("_stored").isNull() | (F.col(record) == first))

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(key, "_key").alias(c)
        if c not in patch_columns:
            return F.col(c)
        new = F.col(f"_patch.{c}")
        if c not in target.columns:
            return F.when(hit, new).alias(c)
        return F.when(hit, new if clear_nulls else F.coalesce(new, F.col(c))).otherwise(F.col(c)).alias(c)

    return joined.select(*[value(c) for c in dict.fromkeys([*target.columns, *fresh.columns])])


def push_entity(name: str, target: DataFrame | None, source: DataFrame, order: str, record: str | None = None) -> DataFrame:
    """Upsert one of the seven entities from its stage table."""
    key, fields, clear_nulls = ENTITY_FIELDS[name]
    rows = source.select(*[value.alias(c) for c, value in fields().items()], F.col(order).alias("_order"))
    return upsert(target, rows, key, "_order", clear_nulls, record)


def parent_links(asset_types: DataFrame) -> DataFrame:
    """``(asset_type_id, parent_asset_type)`` where the parent is itself in the table."""
    ids = asset_types.select(F.col("id").cast("string").alias("parent_asset_type")).distinct()
    children = asset_types.select(
        F.col("id").cast("string").alias("asset_type_id"),
        before_dot(F.col("parent_asset_type_id")).alias("parent_asset_type"),
    )
    return children.join(ids, "parent_asset_type").select("asset_type_id", "parent_asset_type")


# Link name to (source entity key, target entity key, asset column of each).
LINKS = {
    "asset_employee": ("asset_id", "employee_id", "asset_id", "matched_employee_id"),
    "employee_department": ("employee_id", "department_id", "matched_employee_id", "department_id"),
    "asset_product": ("asset_id", "product_id", "asset_id", "product_id"),
    "asset_vendor": ("asset_id", "vendor_id", "asset_id", "vendor_id"),
    "product_asset_type": ("product_id", "asset_type_id", "product_id", "asset_type_id"),
    "asset_purchase": ("asset_id", "purchase_id", "asset_id", "purchase_assignment"),
}


def link(assets: DataFrame, name: str, order: str) -> DataFrame:
    """One link relation: both keys present, and the last asset row (by ``order``) wins per source."""
    src_key, dst_key, src_column, dst_column = LINKS[name]
    edges = assets.select(
        as_long(assets, src_column).alias(src_key), as_long(assets, dst_column).alias(dst_key), F.col(order).alias("_order")
    ).where(F.col(src_key).isNotNull() & F.col(dst_key).isNotNull())
    return edges.groupBy(src_key).agg(F.max_by(dst_key, "_order").alias(dst_key))


def link_counts(assets: DataFrame) -> DataFrame:
    """Rows linked per relation, in one pass over the assets."""
    counts = [
        F.count_if(as_long(assets, s).isNotNull() & as_long(assets, d).isNotNull()).alias(name)
        for name, (_, _, s, d) in LINKS.items()
    ]
    pairs = ", ".join(f"'{n}', {n}" for n in LINKS)
    return assets.agg(*counts).selectExpr(f"stack({len(LINKS)}, {pairs}) AS (relation, linked)")


def add_stubs(entity: DataFrame, key: str, referenced: list[DataFrame]) -> DataFrame:
    """Add a record holding only the key for every referenced id the entity lacks."""
    key_type = entity.schema[key].dataType
    wanted = reduce(DataFrame.unionByName, [r.select(id_text(F.col(key)).cast(key_type).alias(key)) for r in referenced])
    missing = wanted.where(F.col(key).isNotNull()).distinct().join(entity, key, "left_anti")
    return entity.unionByName(missing, allowMissingColumns=True)


def build_links(
    assets: DataFrame, entities: dict[str, DataFrame], order: str
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """All six relations, and the entities with stubs for every id a relation names.

    ``entities`` is keyed by the entity's key column, for example ``asset_id``.
    """
    links = {name: link(assets, name, order) for name in LINKS}
    completed = {}
    for key, entity in entities.items():
        naming = [links[n] for n, (s, d, _, _) in LINKS.items() if key in (s, d)]
        completed[key] = add_stubs(entity, key, naming) if naming else entity
    return links, completed
