"""Catalogue: scans, sinks, column shaping, expressions, enrichment, counts, ids."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assetloom.functions import text as X
from assetloom.functions import values as V
from assetloom.operators import columns as C
from assetloom.operators import employees, enrich, standardise
from assetloom.plans.roles import customer_headcount, dimensions, lineitem_assets, table
from assetloom.operators.depreciation import depreciation_schedule
from assetloom.session import checkpoint_root
from assetloom.sources import pages, readers, stored, writers

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


ENRICH_SQL = """
SELECT l_orderkey, l_linenumber, l_extendedprice AS cost, l_suppkey AS vendor, l_partkey AS product,
       o_custkey AS user_id, c_nationkey AS department_id, n_regionkey AS asset_type_id,
       n_name AS department_name, s_suppkey AS vendor_id, s_name AS vendor_name, c_name AS requester_name,
       r_name AS asset_type_name, p_partkey AS product_id, p_name AS product_name, p_brand AS manufacturer_name,
       p_type AS product_description, p_type || ' ' || p_name AS product_description2
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey
"""


@query("enrich_dims", ENRICH_SQL)
def enrich_dims(spark, sf_dir):
    return enrich.enrich_assets(lineitem_assets(spark, sf_dir), dimensions(spark, sf_dir))


@query(
    "coalesce_key_join",
    """
SELECT o_orderkey AS asset_id, o.name, o.hostname, d.c_name AS device_name, d.c_mktsegment AS platform,
       d.c_nationkey AS version, lower(d.c_name) AS last_logged_username, d.c_acctbal AS last_connect
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') END AS hostname,
             'Customer#' || lpad((o_orderkey // 7)::VARCHAR, 9, '0') AS name FROM orders) o
LEFT JOIN customer d ON coalesce(o.hostname, o.name) = d.c_name
""",
)
def coalesce_key_join(spark, sf_dir):
    assets = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS asset_id",
        "concat('Customer#', lpad(CAST(o_orderkey div 7 AS STRING), 9, '0')) AS name",
        "CASE WHEN o_orderstatus = 'F' THEN concat('Customer#', lpad(CAST(o_custkey AS STRING), 9, '0')) END AS hostname",
    )
    devices = table(spark, sf_dir, "customer").selectExpr(
        "c_name AS name", "c_mktsegment AS platform", "c_nationkey AS version", "lower(c_name) AS last_logged_username",
        "c_acctbal AS last_connect",
    )
    return enrich.add_devices(assets, devices)


@query(
    "duplicate_keys",
    "SELECT l_orderkey AS id, count(*) AS copies FROM lineitem GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_keys(spark, sf_dir):
    return enrich.duplicate_keys(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id"), "id")


@query(
    "flatten_props",
    "SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events",
)
def flatten_props(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("props").alias("type_fields"))
    return C.flatten_bag(events)


@query(
    "flatten_and_consolidate",
    """
SELECT event_id, CASE WHEN event_type <> 'view' THEN user_id::VARCHAR END AS owner,
       greatest(value, CASE WHEN event_type = 'click' THEN 50.0 END) AS memory,
       event_type = 'error' AS failed, 'O''Neil' AS site
FROM events
""",
)
def flatten_and_consolidate(spark, sf_dir):
    """The attribute bag as Python dict text: bare words, both quote styles, suffixed and repeated keys."""
    bag = F.concat(
        F.lit("{'memory_12': "), F.col("value").cast("string"),
        F.lit(", 'memory_7': "), F.when(F.col("event_type") == "click", "50.0").otherwise("None"),
        F.lit(", 'owner_4': "), F.when(F.col("event_type") != "view", F.concat(F.lit("'"), F.col("user_id"), F.lit("'"))).otherwise("None"),
        F.lit(", 'failed_5': "), F.when(F.col("event_type") == "error", "True").otherwise("False"),
        F.lit(", 'site_9': \"O'Neil\"}"),
    )
    events = C.once(table(spark, sf_dir, "events"), bag, "type_fields").select("event_id", "type_fields")
    flat = C.strip_suffixes(C.flatten_bag(events))
    flat = flat.withColumns({c: V.to_number(C.col(c)) for c in flat.columns if c.startswith("memory")})
    return C.consolidate(flat, "memory", "max").withColumn("failed", F.col("failed") == "true")


@query(
    "consolidate",
    """
SELECT l_orderkey, l_linenumber, l_discount + l_tax AS total,
       greatest(l_discount, l_tax) AS most, CASE WHEN l_returnflag <> 'A' THEN l_returnflag ELSE l_linestatus END AS flag
FROM lineitem
""",
)
def consolidate(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.col("l_discount").alias("total"), F.col("l_tax").alias("total.1"),
        F.col("l_discount").alias("most"), F.col("l_tax").alias("most.1"),
        F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("flag"), F.col("l_linestatus").alias("flag.1"),
    )
    return C.consolidate(C.consolidate(C.consolidate(lines, "total", "sum"), "most", "max"), "flag", "first_non_null")


@query(
    "enforce_types",
    """
SELECT c_custkey AS asset_id, CASE WHEN c_acctbal = floor(c_acctbal) THEN c_acctbal::BIGINT END AS vendor_id,
       CAST(NULL AS BIGINT) AS product_id, c_nationkey::BIGINT AS count, c_nationkey::VARCHAR AS asset_tag
FROM customer
""",
)
def enforce_types(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(
        F.concat(F.col("c_custkey").cast("string"), F.lit(".0")).alias("asset_id"),
        F.col("c_acctbal").alias("vendor_id"),
        F.col("c_name").alias("product_id"),
        F.col("c_nationkey").alias("count"),
        F.col("c_nationkey").alias("asset_tag"),
    )
    return C.enforce_types(people)


@query(
    "legacy_float_format",
    """
SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS l_quantity,
       round_even(l_extendedprice, 0)::BIGINT::VARCHAR AS l_extendedprice, round_even(l_discount, 0)::BIGINT::VARCHAR AS l_discount
FROM lineitem
""",
)
def legacy_float_format(spark, sf_dir):
    return writers.legacy_floats(
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    )


@query(
    "merge_append",
    """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS INTEGER) AS nation FROM customer
UNION SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_acctbal > 0 THEN c_nationkey END FROM customer
""",
)
def merge_append(spark, sf_dir):
    people = table(spark, sf_dir, "customer")
    old = people.selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment")
    new = people.selectExpr(
        "CASE WHEN c_acctbal > 0 THEN c_nationkey END AS nation", "c_mktsegment AS segment", "c_name AS name", "c_custkey AS id"
    )
    return writers.merge_append(old, new)


@query(
    "value_counts",
    """
SELECT value, count(*) AS count FROM (SELECT p_brand AS value FROM part
 UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT l_returnflag FROM lineitem) GROUP BY value
""",
)
def value_counts(spark, sf_dir):
    return standardise.combine_counts(
        standardise.value_counts(table(spark, sf_dir, "part"), "p_brand"),
        standardise.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority"),
        standardise.value_counts(table(spark, sf_dir, "lineitem"), "l_returnflag"),
    )


@query(
    "apply_mapping",
    """
SELECT p_partkey, CASE WHEN s_name IS NOT NULL THEN s_name ELSE p_brand END AS p_brand, p_type
FROM part LEFT JOIN (SELECT 'Brand#' || s_suppkey AS raw, CASE WHEN s_acctbal > 2000 THEN s_name END AS s_name FROM supplier) m
ON p_brand = m.raw
""",
)
def apply_mapping(spark, sf_dir):
    mapping = table(spark, sf_dir, "supplier").selectExpr(
        "concat('Brand#', s_suppkey) AS raw", "CASE WHEN s_acctbal > 2000 THEN s_name END AS canonical"
    )
    return standardise.apply_mapping(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), "p_brand", mapping)


@query(
    "standardise_stage",
    """
SELECT p_partkey AS asset_id, CASE WHEN p_brand = 'Brand#1' THEN 'Brand One' ELSE p_brand END AS vendor_name,
       p_type AS asset_type_name, p_name AS product_name, strftime(TIMESTAMP '2024-01-01' + to_days(p_size), '%Y-%m-%d') AS created_at,
       p_size::BIGINT AS display_id, greatest(p_size, p_retailprice) AS memory
FROM part
""",
)
def standardise_stage(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    assets = parts.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("vendor_name"), F.col("p_type").alias("asset_type_name"),
        F.col("p_name").alias("product_name"),
        F.expr("date_format(timestampadd(DAY, p_size, TIMESTAMP '2024-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")").alias("created_at"),
        F.col("p_size").cast("string").alias("display_id"),
        F.col("p_size").cast("double").alias("memory"), F.col("p_retailprice").alias("memory.1"),
    )
    purchases = parts.selectExpr("p_brand AS vendor", "p_type AS asset_class", "p_name AS item", "p_size AS count")
    mapping = {"vendor": parts.selectExpr("p_brand AS raw", "'Brand One' AS canonical").where("raw = 'Brand#1'").distinct()}
    return standardise.standardise(purchases, assets, mapping)[1]


@query(
    "active_employees",
    """
SELECT row_number() OVER (ORDER BY trim(c_name), trim(first_name)) AS employee_id, trim(first_name) AS first_name,
       trim(c_name) AS last_name, lower(c_name) || '@example.org' AS work_email, 'Active' AS status, 'Full-Time' AS employee_type,
       c_custkey::VARCHAR AS title, CAST(NULL AS VARCHAR) AS position_start_date, c_nationkey::VARCHAR AS department,
       CAST(NULL AS VARCHAR) AS termination_date, trim(first_name) || ' ' || c_name AS full_name
FROM (SELECT *, CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE '' END AS first_name FROM customer) WHERE c_mktsegment = 'BUILDING'
""",
)
def active_employees(spark, sf_dir):
    return employees.active_employees(customer_headcount(spark, sf_dir))


@query(
    "number_purchases",
    """
SELECT row_number() OVER (ORDER BY date NULLS LAST, reference) AS purchase_id, date, reference, cost
FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS date, o_orderkey AS reference, o_totalprice AS cost FROM orders)
""",
)
def number_purchases(spark, sf_dir):
    return employees.number_purchases(
        table(spark, sf_dir, "orders").selectExpr(
            "CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS date", "o_orderkey AS reference", "o_totalprice AS cost"
        )
    )


@query(
    "sorted_assets",
    """
SELECT asset_id, created_at, row_number() OVER (ORDER BY created_at NULLS LAST, asset_id) AS place FROM
 (SELECT o_orderkey AS asset_id, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS created_at FROM orders)
""",
)
def sorted_assets(spark, sf_dir):
    """The order of the cleaned assets, as dense places."""
    from assetloom.operators.ranking import dense_ids

    assets = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("asset_id"), F.when(F.col("o_orderstatus") != "P", V.date_text(F.col("o_orderdate"))).alias("created_at")
    )
    return dense_ids(assets, [F.col("created_at").asc_nulls_last(), F.col("asset_id").asc()], "place", unique=True)


@query(
    "clean_text",
    r"""
SELECT page_id, lower(trim(regexp_replace(regexp_replace(html, '<[^\n]*?>', '', 'g'), '\s+', ' ', 'g'))) AS clean FROM pages
""",
)
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.clean_text(F.col("html")).alias("clean"))


@query(
    "parse_dates",
    """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS zulu, strftime(o_orderdate - INTERVAL 5 HOUR, '%Y-%m-%d') AS offset_day,
       strftime(o_orderdate, '%Y-%m-%d') AS head, CAST(NULL AS VARCHAR) AS bad
FROM orders
""",
)
def parse_dates(spark, sf_dir):
    day = V.date_text(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        V.iso_to_utc_date(F.concat(day, F.lit("T10:00:00Z"))).alias("zulu"),
        V.iso_to_utc_date(F.concat(day, F.lit("T00:30:00+05:30"))).alias("offset_day"),
        V.iso_to_utc_date(F.concat(day, F.lit(" at noon"))).alias("head"),
        V.normalise_date(F.col("o_orderpriority")).alias("bad"),
    )


@query(
    "address_lines",
    """
SELECT s_suppkey, concat_ws(', ', s_name, CASE WHEN s_acctbal > 3000 THEN 'St. ' || s_nationkey END, 'US') AS address FROM supplier
""",
)
def address_lines(spark, sf_dir):
    text = F.concat(
        F.lit("{'line1': '"), F.col("s_name"), F.lit("', 'city': '', 'state': "),
        F.when(F.col("s_acctbal") > 3000, F.concat(F.lit("'St. "), F.col("s_nationkey").cast("string"), F.lit("'"))).otherwise("None"),
        F.lit(", 'country': 'US', 'zipcode': None}"),
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.address_line(text).alias("address"))


@query(
    "text_repairs",
    """
SELECT event_id, '  ' || event_type AS raw, event_type AS unquoted, props AS block, event_id::VARCHAR AS id_text,
       (user_id // 1)::VARCHAR AS before_dot, 'Kind ' || CASE WHEN event_type = 'error' THEN 'bad' ELSE event_type END AS kind
FROM events
""",
)
def text_repairs(spark, sf_dir):
    kind = V.map_value(F.col("event_type"), {"error": "bad"})
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("  "), F.col("event_type")).alias("raw"),
        X.clean_quotes(F.concat(F.lit(' "'), F.col("event_type"), F.lit('" '))).alias("unquoted"),
        X.first_braces(F.concat(F.lit("answer:\n"), F.col("props"), F.lit("\nbye"))).alias("block"),
        V.id_text(F.col("event_id").cast("double")).alias("id_text"),
        V.before_dot(F.concat(F.col("user_id"), F.lit(".0"))).alias("before_dot"),
        F.concat(F.lit("Kind "), kind).alias("kind"),
    )


@query(
    "whole_days",
    """
SELECT event_id, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 86400000000.0)::BIGINT AS days FROM events
""",
)
def whole_days(spark, sf_dir):
    noon = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", V.whole_days(F.col("ts").cast("timestamp"), noon).alias("days"))


@query("csv_round_trip", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS cost FROM customer")
def csv_round_trip(spark, sf_dir):
    path = f"{checkpoint_root(spark)}/csv-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS ID", "c_name AS NAME", "c_acctbal AS COST")
    writers.write_csv(rows, path)
    return readers.read_optional_csv(spark, path, "id BIGINT, name STRING, cost DOUBLE")


@query("records_round_trip", "SELECT c_custkey AS record_no, c_name AS full_name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS open_balance FROM customer")
def records_round_trip(spark, sf_dir):
    path = f"{checkpoint_root(spark)}/records-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "customer").select(
        F.struct(
            F.col("c_custkey").alias("Record No"), F.col("c_name").alias("full-name"),
            F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("Open Balance"),
        ).alias("fields")
    )
    rows.write.json(path)
    return readers.read_records(spark, path)


@query("json_map_round_trip", "SELECT c_custkey::VARCHAR AS key, c_nationkey::BIGINT AS value FROM customer")
def json_map_round_trip(spark, sf_dir):
    path = f"{checkpoint_root(spark)}/map-{uuid.uuid4().hex}"
    writers.write_json_map(table(spark, sf_dir, "customer"), path, "c_custkey", "c_nationkey")
    return readers.read_json_map(spark, path)


@query(
    "subresources",
    """
SELECT c_custkey AS display_id, c_name, coalesce('[' || string_agg(props, ',' ORDER BY props) FILTER (event_type = 'click') || ']', 'null') AS click,
       coalesce('[' || string_agg(props, ',' ORDER BY props) FILTER (event_type = 'error') || ']', 'null') AS error
FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY ALL
""",
)
def subresources(spark, sf_dir):
    responses = table(spark, sf_dir, "events").selectExpr("user_id AS display_id", "event_type AS kind", "props AS payload")
    assets = table(spark, sf_dir, "customer").selectExpr("c_custkey AS display_id", "c_name")
    return readers.attach_subresources(assets, responses, ["click", "error"])


@query("subresource_parts", """
WITH placed AS (SELECT user_id, event_type, props, sum(length(props) + 1) OVER w - length(props) - 1 AS place
  FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY props, event_id ROWS UNBOUNDED PRECEDING)),
parted AS (SELECT *, dense_rank() OVER (PARTITION BY user_id, event_type ORDER BY place // 60) AS part FROM placed)
SELECT user_id AS display_id, event_type AS kind, part, count(*) AS n_payloads, '[' || string_agg(props, ',' ORDER BY props) || ']' AS payload
FROM parted GROUP BY ALL""")
def subresource_parts(spark, sf_dir):
    """All responses as JSON parts of about 60 characters, so that most keys have several."""
    responses = table(spark, sf_dir, "events").selectExpr("user_id AS display_id", "event_type AS kind", "props AS payload")
    return readers.subresource_parts(responses, part_chars=60)


@query("stripped_names", "SELECT p_partkey, p_name, p_brand AS vendor FROM part")
def stripped_names(spark, sf_dir):
    return C.strip_names(table(spark, sf_dir, "part").selectExpr("p_partkey AS ` p_partkey `", "p_name AS `p_name\t`", "p_brand AS `  vendor`"))


PAGE_ROWS = 100


@query("paged_source", f"""SELECT 1 + c_custkey // {PAGE_ROWS} AS page, row_number() OVER (PARTITION BY c_custkey // {PAGE_ROWS} ORDER BY c_custkey) - 1 AS row_in_page,
c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment = 'BUILDING' AS active FROM customer""")
def paged_source(spark, sf_dir):
    """All customers landed as pages, an empty page behind them and one after it that a client would never ask for; read as a data source."""
    path = _folder(spark, "pages")
    customers = table(spark, sf_dir, "customer")
    record = F.struct(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), (F.col("c_mktsegment") == "BUILDING").alias("active")
    )
    landed = customers.groupBy((1 + F.floor(F.col("c_custkey") / PAGE_ROWS)).alias("page")).agg(F.array_sort(F.collect_list(record)).alias("records"))
    last = 1 + customers.agg(F.max("c_custkey")).first()[0] // PAGE_ROWS
    first = landed.where("page = 1")
    none = first.select(F.lit(last + 1).alias("page"), F.filter("records", lambda r: F.lit(False)).alias("records"))
    after = first.select(F.lit(last + 2).alias("page"), "records")
    whole = landed.unionByName(none).unionByName(after).select("page", F.to_json(F.struct(F.lit("ok").alias("status"), "records")).alias("value"))
    whole.write.partitionBy("page").text(path)
    pages.register(spark)
    reader = spark.read.format("pages").option("pagePattern", r"page=(\d+)/").option("pagesPerPartition", 8)
    return reader.option("recordSchema", "id bigint, name string, balance double, active boolean").load(path)


@query("stored_append", """SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM orders
UNION SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -1 END, NULL FROM orders""")
def stored_append(spark, sf_dir):
    """All orders stored in buckets; then all orders once more as new rows, some of them equal, some with another price or no status."""
    orders = table(spark, sf_dir, "orders")
    name = f"stored_{uuid.uuid4().hex}"
    first = orders.selectExpr("o_orderkey", "o_custkey", "o_totalprice", "CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status")
    stored.create_stored(first, name, _folder(spark, "stored"), 8)
    new = orders.selectExpr("o_orderkey", "o_custkey", "CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -1 END AS o_totalprice")
    return stored.append_stored(new, name)


@query("depreciation", """
WITH lives AS (SELECT p_partkey AS asset_id, p_retailprice::DECIMAL(18,2) AS cost, DATE '2023-11-15' + p_size::INT AS date, p_size % 9 AS life FROM part),
months AS (SELECT *, date_trunc('month', date)::DATE AS first, day(last_day(date)) AS days, unnest(range(0, CASE WHEN day(date) = 1 THEN life ELSE life + 1 END)) AS n
  FROM lives WHERE life >= 1),
used AS (SELECT *, greatest(0, least(life * days, (n + 1) * days - day(date) + 1)) AS u, greatest(0, least(life * days, n * days - day(date) + 1)) AS v FROM months),
cents AS (SELECT *, (2 * (cost * 100)::BIGINT * u + life * days) // (2 * life * days) AS now, (2 * (cost * 100)::BIGINT * v + life * days) // (2 * life * days) AS before FROM used)
SELECT asset_id, (n + 1)::INT AS period, (first + to_months(n::INT))::DATE AS month, (now - before) / 100.0 AS depreciation, now / 100.0 AS accumulated,
       cost - now / 100.0 AS book_value FROM cents""")
def depreciation(spark, sf_dir):
    """Every part as an asset with a life of up to eight months, some of none."""
    assets = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS asset_id", "p_retailprice AS cost", "date_add(DATE '2023-11-15', CAST(p_size AS INT)) AS date", "p_size % 9 AS useful_life")
    return depreciation_schedule(assets).drop("cost", "date", "useful_life")


def _folder(spark, label):
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


@query("entity_round_trip", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def entity_round_trip(spark, sf_dir):
    path = _folder(spark, "entity")
    writers.write_csv(table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "n_name AS name"), path)
    return readers.read_entity(spark, "departments", path)



@query("read_or_build", "SELECT r_regionkey, r_name FROM region")
def read_or_build(spark, sf_dir):
    """Built once, then read back from the copy."""
    path = _folder(spark, "copy")
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    readers.read_or_build(spark, path, lambda: regions)
    return readers.read_or_build(spark, path, lambda: regions.limit(0))


@query("mapping_round_trip", "SELECT p_name AS raw, min(p_brand) AS canonical FROM part GROUP BY 1")
def mapping_round_trip(spark, sf_dir):
    path = _folder(spark, "mapping")
    writers.write_mapping(table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("raw")).agg(F.min("p_brand").alias("canonical")), path)
    return readers.read_mapping(spark, path)


@query("long_map_values", "SELECT c_custkey::VARCHAR AS key, 9007199254740993 + c_custkey AS value FROM customer")
def long_map_values(spark, sf_dir):
    """Map values that a double cannot hold."""
    path = _folder(spark, "map")
    writers.write_json_map(table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "9007199254740993 + c_custkey AS v"), path, "k", "v")
    return readers.read_json_map(spark, path)


@query("first_append", "SELECT l_orderkey, l_linestatus FROM lineitem")
def first_append(spark, sf_dir):
    """Without a stored table all new rows are written, repeated ones too."""
    return writers.merge_append(None, table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus"))


@query("typed_counts", "SELECT c_custkey, trunc(c_acctbal)::BIGINT AS count, 0::BIGINT AS bad FROM customer")
def typed_counts(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return customers.select("c_custkey", V.to_count(F.col("c_acctbal").cast("string")).alias("count"), V.to_count(F.col("c_name")).alias("bad"))


@query("category_keys", """
SELECT p_partkey AS purchase_id, lower(p_brand) AS vendor_lower, lower(p_name) AS item_lower, lower(p_name || ' ' || p_brand || ' ' || p_type) AS composite_index
FROM part WHERE lower(p_type) = (SELECT lower(min(p_type)) FROM part)
""")
def category_keys(spark, sf_dir):
    """One category of purchase lines that come with the fallback column names."""
    parts = table(spark, sf_dir, "part")
    category = parts.agg(F.min("p_type")).first()[0]
    lines = parts.selectExpr("p_partkey AS purchase_id", "p_brand AS vendor_name", "p_name AS product_name", "p_type AS description", "CAST(1 AS BIGINT) AS count", "p_type AS asset_class")
    return C.purchase_keys(C.only_category(lines, "asset_class", category.upper())).select("purchase_id", "vendor_lower", "item_lower", "composite_index")
