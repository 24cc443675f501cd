"""Catalogue: exact and similar matches, candidates, assignment, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetloom.functions import similarity
from assetloom.operators import assign, matching, people, rematch
from assetloom.operators.columns import asset_keys, purchase_keys
from assetloom.plans.roles import part_assets, part_purchases, table
from assetloom.session import cut

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# Assets, purchases and the similarity of every two composite texts. The scores come from the
# bit-parallel LCS recurrence on BIGINT, which holds because a composite text of part has < 62 characters.
ROLES_SQL = """
assets AS (SELECT p_partkey AS asset_id, p_name AS name, lower(p_name) AS product_name_lower, lower(p_brand) AS vendor_name_lower,
  lower(p_name || ' ' || p_brand || ' ' || p_type) AS t, TIMESTAMP '2024-01-01' + to_days(p_size) AS created_at FROM part),
purchases AS (SELECT p_partkey AS purchase_id, p_name AS item, p_brand AS vendor, lower(p_name) AS item_lower, lower(p_brand) AS vendor_lower,
  lower(p_name || ' ' || p_brand || ' ' || p_type) AS t, p_retailprice AS cost, p_size // 10 - 1 AS remaining_count,
  TIMESTAMP '2024-01-01' + to_days(50 - p_size) AS date FROM part),
stock AS (SELECT * FROM purchases WHERE remaining_count > 0)
"""
PAIRS_SQL = """
texts AS (SELECT t, row_number() OVER (ORDER BY t) AS n, length(t) AS len,
  list_transform(string_split(t, ''), lambda c: ascii(c)) AS codes FROM (SELECT DISTINCT t FROM assets)),
places AS (SELECT n, codes[i] AS code, sum(1::BIGINT << (i - 1)::INT)::BIGINT AS mask
  FROM (SELECT n, codes, unnest(range(1, len + 1)) AS i FROM texts) GROUP BY ALL),
masks AS (SELECT n, list(mask ORDER BY code) AS ms, list(code ORDER BY code) AS cs FROM places GROUP BY n),
tabs AS (SELECT n, list_transform(range(0, 128), lambda k: coalesce(ms[list_position(cs, k::INT)], 0)) AS tab FROM masks),
pairs AS MATERIALIZED (SELECT a.t AS ta, b.t AS tb, 200::DOUBLE * (a.len - bit_count(list_reduce(
    list_transform(b.codes, lambda k: x.tab[k + 1]),
    lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << a.len::INT) - 1),
    (1::BIGINT << a.len::INT) - 1))) / (a.len + b.len) AS score
  FROM texts a JOIN tabs x USING (n), texts b)
"""


@query(
    "exact_match",
    f"""WITH {ROLES_SQL} SELECT asset_id, min(purchase_id) AS purchase_id FROM assets JOIN stock
ON vendor_lower = vendor_name_lower AND item_lower = product_name_lower GROUP BY asset_id""",
)
def exact_match(spark, sf_dir):
    return matching.exact_match(part_assets(spark, sf_dir), part_purchases(spark, sf_dir))


@query(
    "fuzzy_match",
    f"""WITH {ROLES_SQL}, {PAIRS_SQL},
lines AS (SELECT t, min(purchase_id) AS purchase_id FROM stock GROUP BY t),
best AS (SELECT ta, arg_min(purchase_id, (-score, purchase_id)) AS purchase_id, max(score) AS score
  FROM pairs JOIN lines ON tb = t WHERE score > 50 GROUP BY ta)
SELECT asset_id, purchase_id, round(score, 6) AS fuzzy_score FROM assets JOIN best ON t = ta""",
)
def fuzzy_match(spark, sf_dir):
    found = matching.fuzzy_match(part_assets(spark, sf_dir), part_purchases(spark, sf_dir))
    return found.withColumn("fuzzy_score", F.round("fuzzy_score", 6))


@query(
    "first_match",
    f"""WITH {ROLES_SQL}, {PAIRS_SQL},
lines AS (SELECT t, min(purchase_id) AS purchase_id FROM stock GROUP BY t),
best AS (SELECT ta, arg_min(purchase_id, (-score, purchase_id)) AS purchase_id, max(score) AS score
  FROM pairs JOIN lines ON tb = t WHERE score > 50 GROUP BY ta),
ex AS (SELECT asset_id, min(purchase_id) AS purchase_id FROM assets JOIN stock
  ON vendor_lower = vendor_name_lower AND item_lower = product_name_lower GROUP BY asset_id)
SELECT asset_id, purchase_id, CAST(NULL AS DOUBLE) AS fuzzy_score FROM ex UNION ALL
SELECT asset_id, purchase_id, round(score, 6) FROM assets JOIN best ON t = ta WHERE asset_id NOT IN (SELECT asset_id FROM ex)""",
)
def first_match(spark, sf_dir):
    found = matching.first_match(part_assets(spark, sf_dir), part_purchases(spark, sf_dir))
    return found.withColumn("fuzzy_score", F.round("fuzzy_score", 6))


PAGE = 5
CANDIDATES_SQL = f"""{ROLES_SQL}, {PAIRS_SQL},
listed AS (
  SELECT asset_id, purchase_id, 'exact' AS kind, CAST(NULL AS DOUBLE) AS fuzzy_score, date_diff('day', date, created_at) AS date_discrepancy
  FROM assets JOIN stock ON vendor_lower = vendor_name_lower AND item_lower = product_name_lower AND date <= created_at
  UNION ALL
  SELECT asset_id, purchase_id, 'fuzzy', round_even(score, 2), date_diff('day', date, created_at)
  FROM assets a JOIN pairs ON a.t = ta JOIN stock s ON s.t = tb AND date <= created_at
  WHERE round_even(score, 2) > 45 AND NOT (vendor_lower = vendor_name_lower AND item_lower = product_name_lower)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY kind, fuzzy_score DESC, date_discrepancy, purchase_id) AS rank FROM listed)
"""


@query("rank_candidates", f"WITH {CANDIDATES_SQL} SELECT * FROM ranked WHERE rank <= {PAGE}")
def rank_candidates(spark, sf_dir):
    return matching.rank_candidates(part_assets(spark, sf_dir), part_purchases(spark, sf_dir), PAGE)


@query(
    "candidate_display",
    f"""WITH {CANDIDATES_SQL} SELECT asset_id, rank, kind, strftime(date, '%Y-%m-%d') AS date, r.purchase_id::VARCHAR AS purchase_id,
vendor, item, cost::VARCHAR AS cost, remaining_count::VARCHAR AS remaining_count, fuzzy_score::VARCHAR AS fuzzy_score,
date_discrepancy::VARCHAR AS date_discrepancy FROM ranked r JOIN purchases USING (purchase_id) WHERE rank > {PAGE} AND rank <= {2 * PAGE}""",
)
def candidate_display(spark, sf_dir):
    """The second page of every asset's list as the reviewer sees it."""
    purchases = part_purchases(spark, sf_dir)
    return matching.candidate_display(
        matching.rank_candidates(part_assets(spark, sf_dir), purchases, PAGE, page=1), purchases
    )


HOT_SQL = """
stock AS (SELECT o_orderkey AS purchase_id, o_orderstatus AS vendor_lower, o_orderpriority AS item_lower, date_trunc('month', o_orderdate) AS date FROM orders),
assets AS (SELECT c_custkey AS asset_id, CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS vendor, '2-HIGH' AS product,
  TIMESTAMP '1996-01-01' + to_days((c_custkey % 50)::INT) AS created_at FROM customer),
ranked AS (SELECT asset_id, purchase_id, 'exact' AS kind, CAST(NULL AS DOUBLE) AS fuzzy_score, date_diff('day', date, created_at) AS date_discrepancy,
  row_number() OVER (PARTITION BY asset_id ORDER BY date DESC, purchase_id) AS rank
  FROM assets JOIN stock ON vendor = vendor_lower AND product = item_lower AND date <= created_at)
"""


@query("hot_candidates", f"WITH {HOT_SQL} SELECT * FROM ranked WHERE rank <= 8")
def hot_candidates(spark, sf_dir):
    """Orders as purchase lines with few keys and month dates, so that very many candidates tie; customers as assets. Two pages."""
    lines = purchase_keys(
        table(spark, sf_dir, "orders").selectExpr(
            "o_orderkey AS purchase_id", "o_orderstatus AS vendor", "o_orderpriority AS item", "'' AS description",
            "date_trunc('MONTH', o_orderdate) AS date", "CAST(1 AS BIGINT) AS count",
        )
    ).withColumns({"vendor_lower": F.col("vendor"), "item_lower": F.col("item")})
    assets = asset_keys(
        table(spark, sf_dir, "customer").selectExpr(
            "c_custkey AS asset_id", "CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS vendor_name", "'2-HIGH' AS product_name",
            "'' AS description", "timestampadd(DAY, c_custkey % 50, TIMESTAMP '1996-01-01 00:00:00') AS created_at",
        )
    ).withColumns({"vendor_name_lower": F.col("vendor_name"), "product_name_lower": F.col("product_name")})
    first = matching.rank_candidates(assets, lines, 5, threshold=100.0)
    return first.unionByName(matching.rank_candidates(assets, lines, 3, threshold=100.0, after=first))


@query(
    "work_queue",
    f"""WITH {ROLES_SQL},
flagged AS (SELECT asset_id, EXISTS (SELECT 1 FROM stock WHERE vendor_lower = vendor_name_lower AND item_lower = product_name_lower
  AND date <= created_at) AS has_exact FROM assets)
SELECT row_number() OVER w AS place, asset_id, has_exact, lag(asset_id) OVER w AS previous_asset, lead(asset_id) OVER w AS next_asset
FROM flagged WINDOW w AS (ORDER BY has_exact DESC, asset_id)""",
)
def work_queue(spark, sf_dir):
    return matching.work_queue(part_assets(spark, sf_dir), part_purchases(spark, sf_dir))


# The sequential rule itself: one asset per step, the stock list carried along.
AUTO_SQL = f"""WITH RECURSIVE {ROLES_SQL}, {PAIRS_SQL},
lines AS (SELECT *, row_number() OVER (ORDER BY purchase_id) AS ppos FROM stock),
queue AS (SELECT *, row_number() OVER (ORDER BY asset_id) AS pos FROM assets),
wishes AS MATERIALIZED (SELECT pos, any_value(q.asset_id) AS asset_id,
    list((ppos, CASE WHEN vendor_lower = vendor_name_lower AND item_lower = product_name_lower THEN NULL ELSE score END)
      ORDER BY CASE WHEN vendor_lower = vendor_name_lower AND item_lower = product_name_lower THEN 1000 ELSE score END DESC, ppos) AS wish
  FROM queue q JOIN pairs ON q.t = ta JOIN lines s ON s.t = tb
  WHERE score > 50 OR (vendor_lower = vendor_name_lower AND item_lower = product_name_lower) GROUP BY pos),
steps AS (SELECT 0::BIGINT AS pos, CAST(NULL AS BIGINT) AS chosen, CAST(NULL AS DOUBLE) AS score, list(remaining_count::INT ORDER BY ppos) AS rem FROM lines
  UNION ALL
  SELECT pos, best[1], best[2], CASE WHEN best IS NULL THEN rem ELSE
      list_concat(list_slice(rem, 1, best[1] - 1), [rem[best[1]] - 1], list_slice(rem, best[1] + 1, len(rem))) END
  FROM (SELECT s.pos + 1 AS pos, rem, list_filter(wish, lambda w: rem[w[1]] > 0)[1] AS best
        FROM steps s LEFT JOIN wishes w ON w.pos = s.pos + 1 WHERE s.pos < (SELECT count(*) FROM queue)))
"""


@query(
    "auto_match",
    f"""{AUTO_SQL} SELECT asset_id, purchase_id, CASE WHEN score IS NULL THEN 'exact' ELSE 'fuzzy' END AS kind, round(score, 6) AS fuzzy_score
FROM steps JOIN queue USING (pos) JOIN lines ON chosen = ppos""",
)
def auto_match(spark, sf_dir):
    found = assign.auto_match(part_assets(spark, sf_dir), part_purchases(spark, sf_dir))
    return found.withColumn("fuzzy_score", F.round("fuzzy_score", 6))


@query(
    "rematch",
    f"""{AUTO_SQL} SELECT asset_id, purchase_id, CASE WHEN score IS NULL THEN 'exact' ELSE 'fuzzy' END AS kind, round(score, 6) AS fuzzy_score
FROM steps JOIN queue USING (pos) JOIN lines ON chosen = ppos""",
)
def rematch_parts(spark, sf_dir):
    """All parts matched from a stored matching, made when the last tenth of the assets was missing and some late purchases had other stock."""
    assets, purchases = part_assets(spark, sf_dir), part_purchases(spark, sf_dir)
    late = F.col("asset_id") >= F.lit(0.9) * assets.agg(F.max("asset_id")).first()[0]
    assets_before = assets.where(~late)
    other = (F.col("purchase_id") % 50 == 7) & (F.col("remaining_count") > 1)
    purchases_before = purchases.withColumn("remaining_count", F.when(other, F.col("remaining_count") - 1).otherwise(F.col("remaining_count")))
    stored = cut(assign.auto_match(assets_before, purchases_before), "stored")
    found = rematch.rematch(assets, purchases, assets_before, purchases_before, stored)
    return found.withColumn("fuzzy_score", F.round("fuzzy_score", 6))


@query(
    "match_summary",
    f"""{AUTO_SQL} SELECT (SELECT count(*) FROM assets) AS total_assets, (SELECT sum(remaining_count)::BIGINT FROM purchases) AS total_purchase_items,
count(chosen) AS matched, count(chosen) - count(score) AS exact_matches, count(score) AS fuzzy_matches,
(SELECT count(*) FROM assets) - count(chosen) AS unmatched FROM steps""",
)
def match_summary(spark, sf_dir):
    assets, purchases = part_assets(spark, sf_dir), part_purchases(spark, sf_dir)
    return assign.match_summary(assets, purchases, assign.auto_match(assets, purchases))


@query(
    "similarity_scores",
    """
WITH RECURSIVE base AS (SELECT DISTINCT 'supplier ' || lower(a.p_name) AS x, lower(a.p_type || ' ' || a.p_name) AS y FROM part a),
codes AS (SELECT x, y, length(x) AS lx, length(y) AS ly,
  list_transform(string_split(y, ''), lambda c: list_sum(list_transform(range(1, 1 + length(x)),
    lambda i: CASE WHEN substr(x, i, 1) = c THEN (1::BIGINT << (i - 1)::INT) ELSE 0 END))::BIGINT) AS ms FROM base)
SELECT x, y, round(200::DOUBLE * (lx - bit_count(list_reduce(ms, lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << lx::INT) - 1),
  (1::BIGINT << lx::INT) - 1))) / (lx + ly), 6) AS ratio FROM codes
""",
)
def similarity_scores(spark, sf_dir):
    """The ratio as a column function, over every distinct name and type of part."""
    texts = table(spark, sf_dir, "part").selectExpr(
        "concat('supplier ', lower(p_name)) AS x", "lower(concat(p_type, ' ', p_name)) AS y"
    ).distinct()
    return texts.select("x", "y", F.round(similarity.ratio(F.col("x"), F.col("y")), 6).alias("ratio"))


def _roster(spark, sf_dir):
    """Suppliers as employees, under their key as a number without the leading zeros."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS employee_id", "concat('<b>Supplier</b> ', s_name, ' ', s_nationkey) AS full_name"
    )


def _users(spark, sf_dir):
    """Orders as assets: finished ones know who logged on, the others only a requester."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS asset_id",
        "CASE WHEN o_orderstatus = 'F' THEN concat('supplier#', lpad(CAST(o_custkey div 3 AS STRING), 9, '0')) END AS last_logged_username",
        "concat('SUPPLIER', '#', lpad(CAST(o_custkey AS STRING), 9, '0')) AS requester_name",
    )


# The best window of y for a shorter x, by the same LCS recurrence; ms holds the places of y's characters in x.
WINDOWS_SQL = """
codes AS (SELECT x, y, length(x) AS lx, length(y) AS ly, (1::BIGINT << length(x)::INT) - 1 AS whole,
  list_transform(string_split(y, ''), lambda c: list_sum(list_transform(range(1, 1 + length(x)),
    lambda i: CASE WHEN substr(x, i, 1) = c THEN (1::BIGINT << (i - 1)::INT) ELSE 0 END))::BIGINT) AS ms FROM base),
windows AS (SELECT *, list_concat(list_concat(list_transform(range(1, lx), lambda i: [1, i]),
  list_transform(range(1, ly - lx + 2), lambda i: [i, i + lx - 1])), list_transform(range(ly - lx + 2, ly + 1), lambda i: [i, ly])) AS ws FROM codes),
scored AS MATERIALIZED (SELECT x, y, list_max(list_transform(ws, lambda w: 200::DOUBLE * (lx - bit_count(list_reduce(list_slice(ms, w[1], w[2]),
  lambda v, m: ((v + (v & m)) | (v - (v & m))) & whole, whole))) / (lx + w[2] - w[1] + 1))) AS score FROM windows)
"""


@query(
    "partial_scores",
    f"""WITH base AS (SELECT DISTINCT lower(p_brand) AS x, lower(p_type || ' ' || p_name) AS y FROM part), {WINDOWS_SQL}
SELECT x, y, round(score, 6) AS score FROM scored""",
)
def partial_scores(spark, sf_dir):
    """The best-window score as a column function, over every distinct brand, type and name of part."""
    texts = table(spark, sf_dir, "part").selectExpr("lower(p_brand) AS x", "lower(concat(p_type, ' ', p_name)) AS y").distinct()
    return texts.select("x", "y", F.round(similarity.partial_ratio(F.col("x"), F.col("y")), 6).alias("score"))


PEOPLE_SQL = f"""
users AS (SELECT o_orderkey AS asset_id, CASE WHEN o_orderstatus = 'F' THEN 'supplier#' || lpad((o_custkey // 3)::VARCHAR, 9, '0') END AS last_logged_username,
  'SUPPLIER#' || lpad(o_custkey::VARCHAR, 9, '0') AS requester_name FROM orders),
staff AS (SELECT s_suppkey AS employee_id, lower('supplier ' || s_name || ' ' || s_nationkey) AS y FROM supplier),
base AS (SELECT x, y FROM (SELECT DISTINCT last_logged_username AS x FROM users WHERE last_logged_username IS NOT NULL
  UNION SELECT lower(requester_name) FROM users), staff), {WINDOWS_SQL},
best AS (SELECT x, arg_min(employee_id, (-score, employee_id)) AS employee_id FROM scored JOIN staff USING (y) WHERE score >= 80 GROUP BY x),
linked AS (SELECT asset_id, last_logged_username, requester_name, coalesce(a.employee_id, b.employee_id) AS matched_employee_id,
  CASE WHEN a.employee_id IS NOT NULL THEN 'last_logged_username' WHEN b.employee_id IS NOT NULL THEN 'requester_name' END AS match_source
  FROM users LEFT JOIN best a ON a.x = last_logged_username LEFT JOIN best b ON b.x = lower(requester_name))
"""


@query("link_employees", f"WITH {PEOPLE_SQL} SELECT * FROM linked")
def link_employees(spark, sf_dir):
    """Names to employees by best window, from two sources in turn."""
    return people.link_employees(_users(spark, sf_dir), _roster(spark, sf_dir))


@query("employee_map", f"""WITH {PEOPLE_SQL} SELECT asset_id::VARCHAR AS asset_id, matched_employee_id AS employee_id FROM linked
WHERE matched_employee_id IS NOT NULL""")
def employee_map(spark, sf_dir):
    linked = people.link_employees(_users(spark, sf_dir), _roster(spark, sf_dir))
    return people.employee_map(linked)
