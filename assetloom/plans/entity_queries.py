"""Catalogue: saved assignments, upserts, links, views, the whole run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.operators import assignments as A
from assetloom.operators import sync, views
from assetloom.plans import reconcile
from assetloom.plans.matching_queries import AUTO_SQL
from assetloom.plans.roles import event_assets, event_log, event_purchases, order_assets, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


SAVED_SQL = """
saved AS (SELECT asset_id, purchase_id FROM (
  SELECT user_id AS asset_id, CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k')::BIGINT END AS purchase_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND purchase_id IS NOT NULL),
stock AS (SELECT p_partkey AS purchase_id, p_name AS item, p_brand AS vendor, p_size::BIGINT AS count,
  TIMESTAMP '2024-01-01' + to_days(p_size) AS date, p_size - coalesce(used, 0) AS remaining_count
  FROM part LEFT JOIN (SELECT purchase_id, count(*) AS used FROM saved GROUP BY 1) u ON p_partkey = purchase_id)
"""


def _saved(spark, sf_dir):
    return A.current_assignments(event_log(spark, sf_dir))


@query("current_assignments", f"WITH {SAVED_SQL} SELECT * FROM saved")
def current_assignments(spark, sf_dir):
    return _saved(spark, sf_dir)


@query("remaining_stock", f"WITH {SAVED_SQL} SELECT * FROM stock")
def remaining_stock(spark, sf_dir):
    return A.remaining_stock(event_purchases(spark, sf_dir), _saved(spark, sf_dir))


@query("over_allocated", """
WITH used AS (SELECT json_extract_string(props, '$.k')::BIGINT AS purchase_id, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT p_partkey AS purchase_id, p_name AS item, p_size - n AS remaining_count FROM part JOIN used ON p_partkey = purchase_id WHERE n > p_size
""")
def over_allocated(spark, sf_dir):
    """Audit of the whole log as if no event replaced another: more units given out than bought."""
    given = event_log(spark, sf_dir).where(F.col("purchase_id").isNotNull())
    stock = A.remaining_stock(event_purchases(spark, sf_dir), given)
    return A.over_allocated(stock).select("purchase_id", "item", "remaining_count")


@query("replay_assets", f"""WITH {SAVED_SQL} SELECT c_custkey AS asset_id, c_name AS name, purchase_id AS purchase_assignment
FROM customer LEFT JOIN saved ON c_custkey = asset_id""")
def replay_assets(spark, sf_dir):
    return A.replay(event_assets(spark, sf_dir), event_purchases(spark, sf_dir), _saved(spark, sf_dir))[0]


@query("assignment_summary", f"""WITH {SAVED_SQL} SELECT (SELECT count(*) FROM customer) AS total_assets, count(*) AS assigned,
(SELECT count(*) FROM customer) - count(*) AS remaining FROM saved""")
def assignment_summary(spark, sf_dir):
    return A.assignment_summary(event_assets(spark, sf_dir), _saved(spark, sf_dir))


@query("assignment_list", f"""WITH {SAVED_SQL} SELECT asset_id::VARCHAR AS asset_id, c_name AS asset_name, purchase_id::VARCHAR AS purchase_id,
strftime(date, '%Y-%m-%d') AS purchase_date, vendor, item, remaining_count::VARCHAR AS remaining_count
FROM saved JOIN customer ON asset_id = c_custkey JOIN stock USING (purchase_id)""")
def assignment_list(spark, sf_dir):
    saved = _saved(spark, sf_dir)
    stock = A.remaining_stock(event_purchases(spark, sf_dir), saved)
    return A.assignment_list(event_assets(spark, sf_dir), stock, saved)


@query("dangling_assignments", """
SELECT DISTINCT o_custkey AS asset_id, o_orderkey AS purchase_id FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) OR o_orderkey NOT IN (SELECT p_partkey FROM part)
""")
def dangling_assignments(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey AS asset_id", "o_orderkey AS purchase_id")
    return A.dangling_assignments(event_assets(spark, sf_dir), event_purchases(spark, sf_dir), orders)


@query("merge_maps", f"""WITH {SAVED_SQL} SELECT c_custkey AS asset_id, coalesce(purchase_id, c_nationkey) AS purchase_id
FROM customer LEFT JOIN saved ON c_custkey = asset_id""")
def merge_maps(spark, sf_dir):
    old = table(spark, sf_dir, "customer").selectExpr("c_custkey AS asset_id", "CAST(c_nationkey AS BIGINT) AS purchase_id")
    return A.merge_maps(old, _saved(spark, sf_dir), "asset_id", "purchase_id")


# --- upserts -------------------------------------------------------------------------------------


@query("upsert_departments", """
SELECT n_nationkey::VARCHAR AS department_id, CASE WHEN n_regionkey = 0 THEN n_name ELSE 'old ' || n_name END AS name FROM nation
UNION ALL SELECT (1000 + s_suppkey)::VARCHAR, s_name FROM supplier
""")
def upsert_departments(spark, sf_dir):
    """Stored nations: some get a new name, some a null one; suppliers are new."""
    nations = table(spark, sf_dir, "nation")
    stored = nations.selectExpr("CAST(n_nationkey AS STRING) AS department_id", "concat('old ', n_name) AS name")
    renamed = nations.selectExpr("CAST(n_nationkey AS BIGINT) AS id", "CASE WHEN n_regionkey = 0 THEN n_name END AS name")
    added = table(spark, sf_dir, "supplier").selectExpr("1000 + s_suppkey AS id", "s_name AS name")
    return sync.push_entity("departments", stored, renamed.unionByName(added), "id")


@query("upsert_employees", """
SELECT c_custkey::VARCHAR AS employee_id, c_mktsegment AS first_name, c_name AS last_name,
  CASE WHEN c_acctbal > 0 THEN lower(c_name) || '@example.org' ELSE 'old@example.org' END AS work_email,
  'Active' AS status, 'Contractor' AS employee_type, c_nationkey::VARCHAR AS title, '2020-01-01' AS position_start_date,
  CAST(NULL AS VARCHAR) AS termination_date FROM customer
""")
def upsert_employees(spark, sf_dir):
    """A null e-mail must not clear the stored one; a stored column the source leaves null stays."""
    people = table(spark, sf_dir, "customer")
    stored = people.selectExpr(
        "CAST(c_custkey AS STRING) AS employee_id", "'x' AS first_name", "'y' AS last_name", "'old@example.org' AS work_email",
        "'On Leave' AS status", "'Contractor' AS employee_type", "'z' AS title", "'2020-01-01' AS position_start_date",
        "CAST(NULL AS STRING) AS termination_date",
    )
    source = people.selectExpr(
        "c_custkey AS employee_id", "c_mktsegment AS first_name", "c_name AS last_name",
        "CASE WHEN c_acctbal > 0 THEN concat(lower(c_name), '@example.org') END AS work_email", "'Active' AS status",
        "CAST(NULL AS STRING) AS employee_type", "CAST(c_nationkey AS STRING) AS title",
        "CAST(NULL AS STRING) AS position_start_date", "CAST(NULL AS STRING) AS termination_date",
    )
    return sync.push_entity("employees", stored, source, "employee_id")


@query("assign_with_stock", """WITH RECURSIVE log AS (
  SELECT event_id, user_id AS asset_id, ts, CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k')::BIGINT END AS purchase_id,
    row_number() OVER (ORDER BY ts, event_id) AS pos FROM events),
steps AS (SELECT 0::BIGINT AS pos, NULL::BOOLEAN AS taken,
    (SELECT list(p_size::BIGINT ORDER BY p_partkey) FROM part) AS stock, (SELECT list_transform(range(0, max(user_id) + 1), lambda x: 0::BIGINT) FROM events) AS held
  UNION ALL
  SELECT pos, taken,
    CASE WHEN taken AND own <> p THEN list_concat(list_slice(credited, 1, p - 1), [credited[p] - 1], list_slice(credited, p + 1, len(credited))) ELSE credited END,
    list_concat(list_slice(held, 1, asset_id), [CASE WHEN taken THEN p ELSE 0 END], list_slice(held, asset_id + 2, len(held)))
  FROM (SELECT *, own = p AND p > 0 OR coalesce(p > 0 AND credited[p] > 0, false) AS taken FROM (
    SELECT l.pos, l.asset_id, coalesce(l.purchase_id + 1, 0) AS p, held, held[l.asset_id + 1] AS own,
      CASE WHEN held[l.asset_id + 1] > 0 AND held[l.asset_id + 1] <> coalesce(l.purchase_id + 1, 0)
        THEN list_concat(list_slice(stock, 1, held[l.asset_id + 1] - 1), [stock[held[l.asset_id + 1]] + 1], list_slice(stock, held[l.asset_id + 1] + 1, len(stock)))
        ELSE stock END AS credited
    FROM steps s JOIN log l ON l.pos = s.pos + 1)))
SELECT event_id, asset_id, purchase_id, taken FROM steps JOIN log USING (pos) WHERE purchase_id IS NOT NULL""")
def assign_with_stock(spark, sf_dir):
    """The whole event log as assignments that are refused where no stock is left."""
    return A.assign_with_stock(event_log(spark, sf_dir), event_purchases(spark, sf_dir)).drop("ts")


@query("upsert_assets", """
SELECT o_custkey::VARCHAR AS asset_id, arg_max(o_orderpriority, o_orderkey) AS name,
  arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_totalprice > 100000) AS cost,
  arg_max(o_orderstatus, o_orderkey) AS description, CAST(NULL AS VARCHAR) AS serial_number,
  arg_max(strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) AS acquisition_date,
  arg_max(strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%d'), o_orderkey) AS created_at,
  CAST(NULL AS VARCHAR) AS assigned_on, 'In Use' AS asset_state, max(o_orderkey)::VARCHAR AS display_id FROM orders GROUP BY o_custkey
""")
def upsert_assets(spark, sf_dir):
    """Many source rows per key: the last value that is not null wins, column by column."""
    source = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey AS asset_id", "o_orderpriority AS name", "CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS cost",
        "o_orderstatus AS description", "CAST(NULL AS STRING) AS serial_number", "date_format(o_orderdate, 'yyyy-MM-dd') AS acquisition_date",
        "concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T00:00:00+02:00') AS created_at", "'soon' AS assigned_on",
        "'In Use' AS asset_state", "o_orderkey AS display_id",
    )
    return sync.push_entity("assets", None, source, "o_orderkey")


@query("upsert_purchases", """
SELECT o_orderkey::VARCHAR AS purchase_id, o_orderpriority AS reference, strftime(o_orderdate, '%Y-%m-%d') AS date, o_totalprice AS cost,
  CASE WHEN o_orderstatus = 'P' THEN 'old' ELSE o_orderstatus END AS description, o_custkey AS count, CAST(NULL AS VARCHAR) AS note,
  'item ' || o_custkey AS item FROM orders
""")
def upsert_purchases(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    stored = orders.selectExpr("CAST(o_orderkey AS STRING) AS purchase_id", "'old' AS description", "'gone' AS item")
    source = orders.selectExpr(
        "o_orderkey AS purchase_id", "o_orderpriority AS reference", "date_format(o_orderdate, 'yyyy-MM-dd') AS date", "o_totalprice AS cost",
        "CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS description", "CAST(o_custkey AS DOUBLE) AS count",
        "CAST(NULL AS STRING) AS note", "concat('item ', o_custkey) AS item",
    )
    return sync.push_entity("purchases", stored, source, "purchase_id")


@query("upsert_products", """
SELECT p_partkey::VARCHAR AS product_id, p_name AS name, p_brand AS manufacturer, CASE WHEN p_size > 25 THEN p_type END AS description FROM part
""")
def upsert_products(spark, sf_dir):
    source = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "p_name AS name", "p_brand AS manufacturer", "CASE WHEN p_size > 25 THEN p_type END AS description_text"
    )
    return sync.push_entity("products", None, source, "id")


@query("upsert_vendors", """
SELECT s_suppkey::VARCHAR AS vendor_id, CASE WHEN s_acctbal > 5000 THEN s_name ELSE 'stored' END AS name, CAST(NULL AS VARCHAR) AS contact_name,
  lower(s_name) AS email, CAST(NULL AS VARCHAR) AS mobile, concat_ws(', ', s_name, 'US') AS address FROM supplier
""")
def upsert_vendors(spark, sf_dir):
    """Empty texts count as null."""
    suppliers = table(spark, sf_dir, "supplier")
    stored = suppliers.selectExpr("CAST(s_suppkey AS STRING) AS vendor_id", "'stored' AS name")
    source = suppliers.selectExpr(
        "s_suppkey AS id", "CASE WHEN s_acctbal > 5000 THEN s_name ELSE '' END AS name", "'' AS contact_name", "lower(s_name) AS email",
        "CAST(NULL AS STRING) AS mobile", "concat('{\\'line1\\': \\'', s_name, '\\', \\'city\\': \\'\\', \\'state\\': None, \\'country\\': \\'US\\'}') AS address",
    )
    return sync.push_entity("vendors", stored, source, "id")


@query("upsert_asset_types", """
SELECT p_partkey::VARCHAR AS asset_type_id, p_name AS name, CASE WHEN p_size > 25 THEN p_type END AS note FROM part
""")
def upsert_asset_types(spark, sf_dir):
    """The one entity whose null note clears the stored note."""
    parts = table(spark, sf_dir, "part")
    stored = parts.selectExpr("CAST(p_partkey AS STRING) AS asset_type_id", "'old' AS name", "'old' AS note")
    source = parts.selectExpr("p_partkey AS id", "p_name AS name", "CASE WHEN p_size > 25 THEN p_type END AS description")
    return sync.push_entity("asset_types", stored, source, "id")


@query("upsert_first_record", """
SELECT o_orderkey AS record, o_custkey AS k, CASE WHEN o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AND c_name IS NOT NULL
  THEN c_name ELSE o_orderstatus END AS label FROM orders LEFT JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT CAST(NULL AS BIGINT), c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
""")
def upsert_first_record(spark, sf_dir):
    """A target holding a key many times: only its first record is patched."""
    target = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS record", "o_custkey AS k", "o_orderstatus AS label")
    source = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_name AS label", "c_custkey AS _order")
    return sync.upsert(target, source, "k", "_order", record="record")


@query("parent_links", """
SELECT n_nationkey::VARCHAR AS asset_type_id, n_regionkey::VARCHAR AS parent_asset_type FROM nation
UNION ALL SELECT (1000 + c_custkey)::VARCHAR, c_nationkey::VARCHAR FROM customer WHERE c_acctbal > 0
""")
def parent_links(spark, sf_dir):
    """Nations under regions, customers under nations; parent ids come as ``7.0`` and some parents are unknown."""
    nations = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "concat(n_regionkey, '.0') AS parent_asset_type_id")
    customers = table(spark, sf_dir, "customer").selectExpr(
        "1000 + c_custkey AS id", "CASE WHEN c_acctbal > 0 THEN CAST(c_nationkey AS STRING) ELSE '-5.0' END AS parent_asset_type_id"
    )
    return sync.parent_links(nations.unionByName(customers))


# --- links ---------------------------------------------------------------------------------------

LINK_ROWS_SQL = """
rows AS (SELECT o_orderkey AS row_no, o_orderkey // 4 AS asset_id, CASE WHEN o_totalprice >= 20000 THEN o_custkey END AS employee_id,
  c_nationkey::BIGINT AS department_id, o_custkey AS product_id, n_regionkey::BIGINT AS vendor_id, c_nationkey::BIGINT AS asset_type_id,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS purchase_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


def _link_sql(src, dst):
    return f"WITH {LINK_ROWS_SQL} SELECT {src}, arg_max({dst}, row_no) AS {dst} FROM rows WHERE {src} IS NOT NULL AND {dst} IS NOT NULL GROUP BY 1"


def _register_link(name):
    src, dst, _, _ = sync.LINKS[name]

    @query(f"link_{name}", _link_sql(src, dst))
    def link(spark, sf_dir):
        return sync.link(order_assets(spark, sf_dir), name, "row_no")


for _name in sync.LINKS:
    _register_link(_name)


@query("link_counts", f"""WITH {LINK_ROWS_SQL} SELECT unnest(['asset_employee', 'employee_department', 'asset_product', 'asset_vendor',
 'product_asset_type', 'asset_purchase']) AS relation, unnest([count(employee_id), count(employee_id), count(*), count(*), count(*), count(purchase_id)]) AS linked FROM rows""")
def link_counts(spark, sf_dir):
    return sync.link_counts(order_assets(spark, sf_dir))


@query("link_stubs", f"""WITH {LINK_ROWS_SQL}, named AS ({_link_sql('asset_id', 'purchase_id').replace(f'WITH {LINK_ROWS_SQL} ', '')})
SELECT p_partkey::VARCHAR AS purchase_id, p_name AS item FROM part UNION ALL
SELECT purchase_id::VARCHAR, NULL FROM (SELECT DISTINCT purchase_id FROM named) WHERE purchase_id NOT IN (SELECT p_partkey FROM part)""")
def link_stubs(spark, sf_dir):
    """Purchases that a link names but the entity lacks become records with only an id."""
    known = table(spark, sf_dir, "part").selectExpr("CAST(p_partkey AS STRING) AS purchase_id", "p_name AS item")
    return sync.build_links(order_assets(spark, sf_dir), {"purchase_id": known}, "row_no")[1]["purchase_id"]


@query("asset_labels", f"""WITH {LINK_ROWS_SQL}, named AS ({_link_sql('asset_id', 'product_id').replace(f'WITH {LINK_ROWS_SQL} ', '')})
SELECT n.asset_id, concat_ws(' ', n.asset_id::VARCHAR, c_name) AS asset FROM named n JOIN customer ON product_id = c_custkey""")
def asset_labels(spark, sf_dir):
    rows = order_assets(spark, sf_dir)
    links = sync.link(rows, "asset_product", "row_no")
    products = table(spark, sf_dir, "customer").selectExpr("c_custkey AS product_id", "c_name AS name")
    assets = links.selectExpr("asset_id", "asset_id AS display_id")
    return views.asset_labels(assets, links, products)


@query("asset_type_lookup", f"""WITH {LINK_ROWS_SQL}, ap AS ({_link_sql('asset_id', 'product_id').replace(f'WITH {LINK_ROWS_SQL} ', '')}),
pt AS ({_link_sql('product_id', 'asset_type_id').replace(f'WITH {LINK_ROWS_SQL} ', '')})
SELECT DISTINCT asset_id, asset_type_id FROM ap JOIN pt USING (product_id)""")
def asset_type_lookup(spark, sf_dir):
    """An asset's type through its product, which is also a type's assets read backwards."""
    rows = order_assets(spark, sf_dir)
    return views.through(sync.link(rows, "asset_product", "row_no"), sync.link(rows, "product_asset_type", "row_no"), "product_id", "asset_id", "asset_type_id")


@query("department_assets", f"""WITH {LINK_ROWS_SQL}, ae AS ({_link_sql('asset_id', 'employee_id').replace(f'WITH {LINK_ROWS_SQL} ', '')}),
ed AS ({_link_sql('employee_id', 'department_id').replace(f'WITH {LINK_ROWS_SQL} ', '')})
SELECT DISTINCT department_id, asset_id FROM ae JOIN ed USING (employee_id)""")
def department_assets(spark, sf_dir):
    rows = order_assets(spark, sf_dir)
    return views.through(sync.link(rows, "asset_employee", "row_no"), sync.link(rows, "employee_department", "row_no"), "employee_id", "department_id", "asset_id")


@query("reverse_links", f"""WITH {LINK_ROWS_SQL}, av AS ({_link_sql('asset_id', 'vendor_id').replace(f'WITH {LINK_ROWS_SQL} ', '')})
SELECT DISTINCT vendor_id, asset_id FROM av""")
def reverse_links(spark, sf_dir):
    return views.reverse(sync.link(order_assets(spark, sf_dir), "asset_vendor", "row_no"), "asset_id", "vendor_id")


@query("reverse_counts", f"""WITH {LINK_ROWS_SQL}, ed AS ({_link_sql('employee_id', 'department_id').replace(f'WITH {LINK_ROWS_SQL} ', '')})
SELECT department_id, count(*) AS linked FROM ed GROUP BY 1""")
def reverse_counts(spark, sf_dir):
    links = sync.link(order_assets(spark, sf_dir), "employee_department", "row_no")
    return views.reverse_counts(links, "employee_id", "department_id")


@query("purchase_devices", """
SELECT DISTINCT o_orderkey AS purchase_id, c_name AS device_name FROM orders JOIN customer ON c_custkey IN (o_custkey, o_custkey * 2)
""")
def purchase_devices(spark, sf_dir):
    serials = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS purchase_id",
        "array(concat('Customer#', lpad(CAST(o_custkey AS STRING), 9, '0')), concat('Customer#', lpad(CAST(o_custkey * 2 AS STRING), 9, '0'))) AS serial",
    )
    return views.purchase_devices(serials, table(spark, sf_dir, "customer").selectExpr("c_name AS name"))


def _outcome(spark, sf_dir):
    """Parts as assets and purchases, customers as staff, through every stage; memory comes as two attributes."""
    parts = table(spark, sf_dir, "part")
    bag = F.concat(
        F.lit("{'vendor_1': "), F.regexp_extract("p_brand", r"(\d+)", 1), F.lit(", 'product_2': "), F.col("p_partkey").cast("string"),
        F.lit(", 'hostname_3': None, 'memory_4': "), F.col("p_size").cast("string"), F.lit(", 'memory_5': "), (F.col("p_size") + 1).cast("string"), F.lit("}"),
    )
    assets = parts.select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("display_id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"),
        (F.col("p_size") % 25).cast("bigint").alias("department_id"), F.col("p_partkey").alias("user_id"),
        F.expr("date_format(timestampadd(DAY, p_size, TIMESTAMP '2024-01-01 00:00:00'), 'yyyy-MM-dd')").alias("created_at"),
        F.lit(None).cast("string").alias("acquisition_date"), F.lit(None).cast("string").alias("assigned_on"),
        F.lit("In Use").alias("asset_state"), F.lit(None).cast("string").alias("serial_number"), F.col("p_retailprice").alias("cost"),
        F.lit(1).cast("bigint").alias("asset_type_id"), bag.alias("type_fields"),
    )
    purchases = parts.selectExpr(
        "p_partkey AS purchase_id", "date_format(timestampadd(DAY, 50 - p_size, TIMESTAMP '2024-01-01 00:00:00'), 'yyyy-MM-dd') AS date",
        "p_type AS asset_class", "'ref' AS reference", "p_brand AS vendor", "p_type AS description", "p_retailprice AS cost", "p_name AS item",
        "CAST(p_size div 10 - 1 AS DOUBLE) AS count", "CAST(NULL AS STRING) AS note",
    )
    brands = parts.selectExpr("CAST(regexp_extract(p_brand, '(\\\\d+)', 1) AS BIGINT) AS id", "p_brand AS name").distinct()
    raw = {
        "assets": assets,
        "purchases": purchases,
        "headcount": table(spark, sf_dir, "customer").selectExpr(
            "c_mktsegment AS first_name", "c_name AS last_name", "c_name AS work_email", "'Active' AS status", "'Full-Time' AS employee_type",
            "'t' AS title", "CAST(NULL AS STRING) AS position_start_date", "CAST(c_nationkey AS STRING) AS department", "CAST(NULL AS STRING) AS termination_date",
        ),
        "departments": table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "n_name AS name"),
        "vendors": brands.selectExpr("id", "name", "CAST(NULL AS STRING) AS contact_name", "CAST(NULL AS STRING) AS email", "CAST(NULL AS STRING) AS mobile", "CAST(NULL AS STRING) AS address"),
        "requesters": table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "concat(c_mktsegment, ' ', c_name) AS name"),
        "asset_types": table(spark, sf_dir, "region").selectExpr("CAST(r_regionkey AS BIGINT) AS id", "r_name AS name", "r_name AS description", "CAST(NULL AS STRING) AS parent_asset_type_id"),
        "products": parts.selectExpr("p_partkey AS id", "p_name AS name", "p_brand AS manufacturer", "p_type AS description", "p_type AS description_text"),
    }
    return reconcile.run(raw)


# The whole run in SQL: the sequential assignment in asset order, and names that equal one employee's.
RUN_SQL = AUTO_SQL.replace("(ORDER BY asset_id) AS pos FROM assets", "(ORDER BY created_at, asset_id) AS pos FROM assets") + """,
bought AS (SELECT asset_id, purchase_id FROM steps JOIN queue USING (pos) JOIN lines ON chosen = ppos),
staff AS (SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_mktsegment) AS employee_id FROM customer),
linked AS (SELECT p_partkey AS asset_id, n_name AS department_name, p_brand AS vendor_name, p_name AS product_name,
  c_mktsegment || ' ' || c_name AS requester_name, purchase_id AS purchase_assignment, employee_id AS matched_employee_id,
  CASE WHEN employee_id IS NOT NULL THEN 'requester_name' END AS match_source, (p_size + 1)::DOUBLE AS memory,
  (p_size % 25)::BIGINT AS department_id, regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS vendor_id
  FROM part LEFT JOIN nation ON n_nationkey = p_size % 25 LEFT JOIN customer ON c_custkey = p_partkey
  LEFT JOIN staff USING (c_custkey) LEFT JOIN bought ON bought.asset_id = p_partkey)
"""


@query("reconcile_all", f"WITH RECURSIVE {RUN_SQL.removeprefix('WITH RECURSIVE')} SELECT * EXCLUDE (department_id, vendor_id) FROM linked")
def reconcile_all(spark, sf_dir):
    """One row per linked asset of the whole run."""
    return _outcome(spark, sf_dir).linked_assets.select(
        "asset_id", "department_name", "vendor_name", "product_name", "requester_name", "purchase_assignment", "matched_employee_id",
        "match_source", "memory",
    )


@query("reconcile_links", f"""WITH RECURSIVE {RUN_SQL.removeprefix('WITH RECURSIVE')}
SELECT 'asset_employee' AS relation, asset_id AS source, matched_employee_id AS target FROM linked WHERE matched_employee_id IS NOT NULL
UNION ALL SELECT 'employee_department', matched_employee_id, department_id FROM linked WHERE matched_employee_id IS NOT NULL
UNION ALL SELECT 'asset_product', asset_id, asset_id FROM linked
UNION ALL SELECT 'asset_vendor', asset_id, vendor_id FROM linked
UNION ALL SELECT 'product_asset_type', asset_id, 1 FROM linked
UNION ALL SELECT 'asset_purchase', asset_id, purchase_assignment FROM linked WHERE purchase_assignment IS NOT NULL""")
def reconcile_links(spark, sf_dir):
    """All six relations of the whole run."""
    links = _outcome(spark, sf_dir).links
    rows = [
        links[name].select(F.lit(name).alias("relation"), F.col(source).alias("source"), F.col(target).cast("bigint").alias("target"))
        for name, (source, target, _, _) in sync.LINKS.items()
    ]
    return reduce(DataFrame.unionByName, rows)


@query("reconcile_entities", """
SELECT 'asset_id' AS entity, p_partkey::VARCHAR AS key, p_name AS name FROM part
UNION ALL SELECT 'purchase_id', p_partkey::VARCHAR, p_name FROM part
UNION ALL SELECT 'product_id', p_partkey::VARCHAR, p_name FROM part
UNION ALL SELECT 'employee_id', (row_number() OVER (ORDER BY c_name, c_mktsegment))::VARCHAR, c_mktsegment FROM customer
UNION ALL SELECT 'department_id', n_nationkey::VARCHAR, n_name FROM nation
UNION ALL SELECT 'asset_type_id', r_regionkey::VARCHAR, r_name FROM region
UNION ALL SELECT DISTINCT 'vendor_id', regexp_extract(p_brand, '(\\d+)', 1), p_brand FROM part
""")
def reconcile_entities(spark, sf_dir):
    """All seven entities of the whole run by key, with the name (item, first name) of each."""
    named = {"purchase_id": "item", "employee_id": "first_name"}
    rows = [
        entity.select(F.lit(key).alias("entity"), F.col(key).cast("string").alias("key"), F.col(named.get(key, "name")).alias("name"))
        for key, entity in _outcome(spark, sf_dir).entities.items()
    ]
    return reduce(DataFrame.unionByName, rows)
