"""Ledger tables over the driver's star-schema tables.

The texts are SQL that Spark and DuckDB both run, so queries and their oracles start from the same rows. Braces stand for
tables. Base transactions come from orders. For operators that would find nothing in those, mirror legs in the next
account of the same user, same-day duplicates of some legs, and recurring charges are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import spread

ACCOUNT = """
SELECT c_custkey AS account_id, CAST(c_nationkey AS BIGINT) AS user_id, c_custkey % 40 AS connection_id,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'loan' WHEN 'BUILDING' THEN 'investment' WHEN 'MACHINERY' THEN 'credit' ELSE 'depository' END AS type,
  CAST(round(c_acctbal * 100) AS BIGINT) AS current_balance, DATE '1995-01-01' + CAST(c_custkey % 900 AS INT) AS linked_at,
  CASE WHEN c_custkey % 5 = 0 THEN concat('My ', c_mktsegment) END AS nickname, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS official_name,
  concat('Bank ', CAST(c_custkey % 7 AS VARCHAR(9))) AS institution_name, lower(c_mktsegment) AS subtype,
  CASE WHEN c_custkey % 17 = 0 THEN true WHEN c_custkey % 2 = 0 THEN false END AS archived
FROM {customer}
"""

CONNECTION = """
SELECT CAST(s_suppkey AS BIGINT) AS connection_id, CAST(s_nationkey AS BIGINT) AS user_id, CASE WHEN s_suppkey % 5 = 0 THEN 'login_required' WHEN s_suppkey % 7 = 0 THEN 'error' ELSE 'active' END AS status,
  CASE WHEN s_suppkey % 3 > 0 THEN DATE '2001-08-01' - CAST(s_suppkey % 30 AS INT) END AS last_synced_at, s_name AS provider_item_id
FROM {supplier}
"""

TXN = """
WITH acct AS (SELECT c_custkey, c_nationkey, coalesce(lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey), min(c_custkey) OVER (PARTITION BY c_nationkey)) AS next_key FROM {customer}),
base AS (
  SELECT o_orderkey * 10 AS tx_id, CAST(c_nationkey AS BIGINT) AS user_id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS date,
    CAST(round(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderstatus = 'O' THEN -1 ELSE 1 END AS amount, substr(o_orderpriority, 3) AS category,
    o_orderstatus = 'P' AND o_orderkey % 7 = 0 AS pending, o_orderkey % 23 = 0 AS is_removed, o_orderkey % 10 = 0 AS signal, o_orderkey AS k, next_key
  FROM {orders} JOIN acct ON o_custkey = c_custkey),
mirror AS (
  SELECT tx_id + 1 AS tx_id, user_id, next_key AS account_id, date + CAST((k / 10) % 5 AS INT) AS date,
    CASE WHEN amount > 0 THEN -1 ELSE 1 END * (abs(amount) + CAST((k / 10) % 3 AS BIGINT) * 60) AS amount, category, pending, is_removed, k % 20 = 0 AS signal, k, next_key
  FROM base WHERE k % 10 = 0),
twin AS (SELECT tx_id + 1 AS tx_id, user_id, account_id, date, amount, category, pending, is_removed, signal, k, next_key FROM mirror WHERE k % 50 = 0),
charge AS (
  SELECT 1000000000000 + c_custkey * 10 + n AS tx_id, CAST(c_nationkey AS BIGINT) AS user_id, c_custkey AS account_id,
    DATE '1997-01-06' + CAST(n * CASE c_custkey % 3 WHEN 0 THEN 30 WHEN 1 THEN 365 ELSE 7 END AS INT) AS date,
    CAST(1599 + c_custkey % 900 + CASE WHEN n = 7 THEN 100 ELSE 0 END AS BIGINT) AS amount, 'Subscriptions' AS category, false AS pending, false AS is_removed, false AS signal, c_custkey AS k, c_custkey AS next_key
  FROM {customer} CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) steps WHERE c_custkey % 5 = 0),
everything AS (
  SELECT *, 'order' AS origin FROM base UNION ALL SELECT *, 'mirror' AS origin FROM mirror UNION ALL SELECT *, 'mirror' AS origin FROM twin UNION ALL SELECT *, 'charge' AS origin FROM charge)
SELECT tx_id, user_id, account_id, date, amount, pending, is_removed,
  CASE WHEN origin = 'charge' THEN concat('Sub ', CAST(account_id AS VARCHAR(20))) WHEN k % 4 > 0 THEN concat('SQ *Shop_', CAST(k % 60 AS VARCHAR(20)), CASE WHEN k % 9 = 0 THEN 'x' ELSE '' END) END AS merchant_name,
  CASE WHEN k % 50 = 3 THEN 'Renamed' END AS merchant_override, concat('Purchase at Store ', CAST(k % 40 AS VARCHAR(20))) AS description,
  CASE WHEN signal THEN CASE WHEN k % 4 = 0 THEN 'LOAN_PAYMENTS_CREDIT_CARD_PAYMENT' ELSE 'TRANSFER_OUT' END ELSE upper(category) END AS provider_category,
  CASE WHEN k % 3 = 0 THEN 4 ELSE CAST(1 + k % 3 AS INT) END AS category_tier, CASE WHEN k % 6 = 0 THEN 'Uncategorized' ELSE category END AS category_value, CASE WHEN k % 6 = 0 THEN 'needs_review' ELSE 'confirmed' END AS category_status,
  CASE WHEN k % 31 = 0 THEN true WHEN k % 2 = 0 THEN false END AS exclude_from_cash_flow
FROM everything
"""

#: Exact rules name shops that the user's orders have, some of them twice; patterns name stores, and a few go over many.
RULES = """
WITH seen AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS user_id, CAST(o_orderkey % 60 AS INT) AS shop, CAST(o_orderkey % 40 AS INT) AS store FROM {orders} JOIN {customer} ON o_custkey = c_custkey),
shops AS (SELECT DISTINCT user_id, shop FROM seen WHERE shop % 6 = 1), stores AS (SELECT DISTINCT user_id, store FROM seen WHERE store % 8 = 4), users AS (SELECT DISTINCT user_id FROM seen)
SELECT user_id, 'exact' AS match_type, concat('sq shop ', CAST(shop AS VARCHAR(9))) AS pattern, CASE shop % 4 WHEN 1 THEN 'Groceries' ELSE 'Travel' END AS category, 0 AS priority, shop AS ordinal FROM shops
UNION ALL SELECT user_id, 'exact', concat('sq shop ', CAST(shop AS VARCHAR(9))), 'Dining', 0, 100 + shop FROM shops WHERE shop % 12 = 1
UNION ALL SELECT user_id, 'regex', concat('store ', CAST(store AS VARCHAR(9)), '$'), concat('Store ', CAST(store AS VARCHAR(9))), store % 5, 200 + store FROM stores
UNION ALL SELECT user_id, 'regex', r.pattern, r.category, r.priority, r.ordinal FROM users CROSS JOIN (
  SELECT 'store 1[0-9]' AS pattern, 'Home' AS category, 2 AS priority, 304 AS ordinal UNION ALL SELECT 'STORE 12', 'Garden', 1, 305 UNION ALL SELECT 'store (', 'Broken', 0, 306 UNION ALL SELECT '^purchase at store 3', 'Fuel', 1, 307
  UNION ALL SELECT concat('(?<place>store) (?:', chr(92), 'd|2', chr(92), 'd)$'), 'Numbered', 3, 308) r
"""

#: The categories that a user's orders have, in order of their names.
CATEGORY = """
SELECT user_id, name, ordinal, ordinal % 8 AS color, concat('icon-', lower(name)) AS icon, (user_id + ordinal) % 3 > 0 AS is_default, CASE WHEN (user_id + ordinal) % 5 = 0 THEN true WHEN (user_id + ordinal) % 7 > 0 THEN false END AS archived,
  CASE (user_id + ordinal) % 4 WHEN 0 THEN 'income' WHEN 1 THEN 'expense' WHEN 2 THEN 'expense' END AS kind
FROM (SELECT user_id, name, CAST(row_number() OVER (PARTITION BY user_id ORDER BY name) - 1 AS INT) AS ordinal
  FROM (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS user_id, substr(o_orderpriority, 3) AS name FROM {orders} JOIN {customer} ON o_custkey = c_custkey) n) c
"""


def load(spark: SparkSession, sf_dir: str, text: str, dealt: bool = False) -> DataFrame:
    """dealt: orders meet customers by a shuffle, whatever size Spark takes the customers to be."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders", "nation", "supplier") if "{" + t + "}" in text}
    if dealt and "orders" in tables:
        tables["orders"] = spread(tables["orders"])
    return spark.sql(text.replace("VARCHAR(9)", "STRING").replace("VARCHAR(20)", "STRING"), **tables)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, ACCOUNT)


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, CONNECTION)


def rules(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    return load(spark, sf_dir, RULES, dealt)


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, CATEGORY)


def transactions(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The transaction table with its nested category and merchant key."""
    from ..functions.scalar import merchant_key

    rows = load(spark, sf_dir, TXN, dealt)
    category = F.struct(F.col("category_tier").alias("tier"), F.col("category_value").alias("value"), F.lit(None).cast("double").alias("confidence"), F.col("category_status").alias("status"))
    rows = rows.withColumn("category", category).withColumn("merchant_norm", merchant_key(F.col("merchant_name"), F.col("description"))).withColumn("transfer_group_id", F.lit(None).cast("string"))
    return rows.drop("category_tier", "category_value", "category_status")


def sql(text: str) -> str:
    """A CTE list t(able) for DuckDB: account, connection, rule, cat and txn, followed by text."""
    plain = {k: v.format(customer="customer", orders="orders", nation="nation", supplier="supplier") for k, v in (("account", ACCOUNT), ("connection", CONNECTION), ("rule", RULES), ("cat", CATEGORY), ("txn0", TXN))}
    key = "trim(regexp_replace(lower(CASE WHEN length(trim(coalesce(merchant_name, ''))) > 0 THEN merchant_name ELSE description END), '[^a-z0-9]+', ' ', 'g'))"
    parts = [f"{k} AS ({v})" for k, v in plain.items()]
    return "WITH RECURSIVE " + ", ".join([*parts, f"txn AS (SELECT *, {key} AS merchant_norm, NOT is_removed AND NOT coalesce(exclude_from_cash_flow, false) AS included FROM txn0)"]) + text
