"""The whole run in one Spark application, from raw tables to links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.operators.assign import auto_match, match_summary, with_assignments
from assetloom.operators.assignments import merge_maps
from assetloom.operators.columns import INT_COLUMNS_LINKING, asset_keys, enforce_types, only_category, purchase_keys
from assetloom.operators.employees import active_employees, number_purchases
from assetloom.operators.enrich import flatten_and_enrich
from assetloom.operators.people import employee_map, link_employees
from assetloom.operators.ranking import dense_ids
from assetloom.operators.standardise import standardise
from assetloom.operators.sync import ENTITY_FIELDS, build_links, push_entity
from assetloom.session import cut, tune


ROW = "_row"


@dataclass
class Outcome:
    """What a run produces; every part is a DataFrame over whole tables."""

    linked_assets: DataFrame
    matches: DataFrame
    summary: DataFrame
    entities: dict[str, DataFrame]
    links: dict[str, DataFrame]
    assignments: DataFrame
    employee_map: DataFrame


def run(
    raw: dict[str, DataFrame],
    mappings: dict[str, DataFrame] | None = None,
    stored: dict[str, DataFrame] | None = None,
    category: str | None = None,
    bag_keys: list[str] | None = None,
) -> Outcome:
    """Process, standardise, match, assign, upsert and link.

    ``raw`` holds ``assets``, ``purchases``, ``headcount`` and the dimension
    tables that exist; ``stored`` the entity tables and the maps ``assignments``
    and ``employee_map`` of an earlier run.
    """
    stored = stored or {}
    tune(raw["assets"].sparkSession)
    employees = cut(active_employees(raw["headcount"]), "employees")
    enriched = cut(flatten_and_enrich(raw["assets"], raw, keys=bag_keys), "enriched")
    purchases = raw["purchases"]
    if "purchase_id" not in purchases.columns:
        purchases = number_purchases(purchases)
    purchases, assets = standardise(purchases, enriched, mappings or {})
    purchases = cut(purchase_keys(only_category(purchases, "asset_class", category)), "purchases")
    # Assets are processed from old to new; ROW is their place and names a row even where ids repeat.
    order = [F.col("created_at").asc_nulls_last(), F.col("asset_id").asc_nulls_last()]
    assets = cut(dense_ids(asset_keys(only_category(assets, "asset_type_name", category)), order, ROW), "cleaned")

    matches = cut(auto_match(assets, purchases, asset_order=(ROW,), row=ROW), "matches")
    linked = link_employees(with_assignments(assets, matches, ROW), employees)
    linked = cut(enforce_types(linked, INT_COLUMNS_LINKING), "linked")

    sources = {"assets": (assets, ROW), "employees": (employees, "employee_id"), "purchases": (purchases, "purchase_id")}
    for name in ("asset_types", "departments", "products", "vendors"):
        if name in raw:
            sources[name] = dense_ids(raw[name], [F.col("id").asc_nulls_last()], ROW), ROW
    entities = {}
    for name, (source, place) in sources.items():
        entities[ENTITY_FIELDS[name][0]] = push_entity(name, stored.get(name), source, place)
    links, completed = build_links(linked, entities, ROW)
    saved = linked.where("purchase_assignment IS NOT NULL").groupBy("asset_id").agg(F.max_by("purchase_assignment", ROW).alias("purchase_id"))
    known = employee_map(linked, ROW)
    if "assignments" in stored:
        saved = merge_maps(stored["assignments"], saved, "asset_id", "purchase_id")
    if "employee_map" in stored:
        known = merge_maps(stored["employee_map"], known, "asset_id", "employee_id")
    return Outcome(linked.drop(ROW), matches.drop(ROW), match_summary(assets, purchases, matches), completed, links, saved, known)
