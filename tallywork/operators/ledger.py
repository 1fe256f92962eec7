"""Ledger reads: filtered pages, account and category lists, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranges
from ..functions import scalar as S
from .aggregate import in_range


def by_id(df: DataFrame, column: str, value) -> DataFrame:
    """The row of an id; none for a value that the column can't hold. The value is cast, not the column, so the filter reaches the scan."""
    kind = df.schema[column].dataType
    return df.filter(F.col(column) == F.lit(str(value)).try_cast(kind)).limit(1)


def by_email(users: DataFrame, email: str) -> DataFrame:
    """The user of an address; stored addresses are in lower case."""
    return users.filter(F.col("email") == email.lower()).limit(1)


def rename_accounts(accounts: DataFrame, changes: DataFrame) -> DataFrame:
    """accounts with new nicknames (user_id, account_id, nickname; null clears it); those of another user's accounts change nothing."""
    c = changes.select("user_id", "account_id", F.struct("nickname").alias("__c"))
    rows = accounts.join(c, ["user_id", "account_id"], "left")
    return rows.withColumn("nickname", F.when(F.col("__c").isNotNull(), F.col("__c.nickname")).otherwise(F.col("nickname"))).select(*accounts.columns)


def archive_accounts(accounts: DataFrame, chosen: DataFrame) -> DataFrame:
    """accounts of which the chosen (user_id, account_id) are archived; another user's stay as they are."""
    rows = accounts.join(chosen.select("user_id", "account_id", F.lit(True).alias("__c")).distinct(), ["user_id", "account_id"], "left")
    return rows.withColumn("archived", F.coalesce("__c", "archived")).select(*accounts.columns)


def by_date(txn: DataFrame, user_id, start, end, with_removed: bool = False) -> DataFrame:
    rows = txn.filter((F.col("user_id") == user_id) & in_range(start, end))
    return (rows if with_removed else rows.filter(~F.col("is_removed"))).orderBy(F.desc("date"), "tx_id")


def page(txn: DataFrame, user_id, number: int = 1, size: int = 50, status=None, category=None, account_id=None, start=None, end=None) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, one row has_more), by date, latest first; one row more than the page is looked at."""
    number, size = ranges.checked_page(number, size)
    rows = txn.filter((F.col("user_id") == user_id) & ~F.col("is_removed") & in_range(start, end))
    for column, value in (("category.status", status), ("category.value", category), ("account_id", account_id)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    ahead = rows.orderBy(F.desc("date"), "tx_id").offset((number - 1) * size).limit(size + 1)
    return ahead.limit(size), ahead.agg((F.count("*") > size).alias("has_more"))


def needs_review(txn: DataFrame) -> DataFrame:
    return txn.filter(~F.col("is_removed") & (F.col("category.status") == "needs_review"))


def ledger_view(txn: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows with their account; a row whose account is missing has 'Unknown account'."""
    a = accounts.select("account_id", S.display_account(F.col("nickname"), F.col("official_name"), F.col("institution_name")).alias("account_name"), F.col("type").alias("account_type"))
    rows = txn.join(a, "account_id", "left")
    return rows.select(
        "user_id", "tx_id", "date", "amount", S.display_merchant(F.col("merchant_override"), F.col("merchant_name"), F.col("merchant_norm")).alias("merchant"), "description", "pending", F.col("category.value").alias("category"),
        F.col("category.status").alias("status"), F.col("category.tier").alias("tier"), F.col("transfer_group_id").isNotNull().alias("is_transfer"), F.coalesce("account_name", F.lit("Unknown account")).alias("account_name"), F.coalesce("account_type", F.lit("")).alias("account_type"),
    )


def account_list(accounts: DataFrame, connections: DataFrame) -> DataFrame:
    """Accounts that are not archived with their connection's state; without a connection: 'error'."""
    c = connections.select("connection_id", "status", "last_synced_at")
    rows = accounts.filter(~F.coalesce("archived", F.lit(False))).join(c, "connection_id", "left")
    return rows.withColumn("status", F.coalesce("status", F.lit("error"))).orderBy("institution_name", "subtype", "account_id")


def syncable(connections: DataFrame) -> DataFrame:
    """Connections that a poll should sync: a broken one waits for its user."""
    return connections.filter("status = 'active'")


def after_errors(connections: DataFrame, errors: DataFrame) -> DataFrame:
    """connections after failed runs (connection_id, kind): terminal kinds set the status, others leave it."""
    last = errors.select("connection_id", S.terminal_status(F.col("kind")).alias("__s")).filter("__s is not null").groupBy("connection_id").agg(F.max("__s").alias("__s"))
    return connections.join(last, "connection_id", "left").withColumn("status", F.coalesce("__s", "status")).select(*connections.columns)


def user_ids(*tables: DataFrame) -> DataFrame:
    """Every user that a table names."""
    rows = None
    for df in tables:
        rows = df.select("user_id") if rows is None else rows.union(df.select("user_id"))
    return rows.distinct()


def with_category_style(rows: DataFrame, categories: DataFrame) -> DataFrame:
    style = categories.select("user_id", F.col("name").alias("category"), "color", "icon")
    return rows.join(style, ["user_id", "category"], "left")


def active_categories(categories: DataFrame) -> DataFrame:
    """archived must be false; an absent mark hides a category, unlike an account."""
    return categories.filter(F.coalesce(F.col("archived") == F.lit(False), F.lit(False))).orderBy("user_id", "ordinal")


def category_groups(categories: DataFrame) -> DataFrame:
    kind = S.category_kind(F.col("kind"))
    return categories.withColumn("section", F.when(~F.col("is_default"), "custom").when(kind == "income", "default-income").otherwise("default-expense"))


def seed_categories(stored: DataFrame, seeds: DataFrame) -> DataFrame:
    """stored and the seeds (user_id, name, seed) it lacks, in order behind them, with the palette's colours in turn."""
    new = seeds.join(stored.select("user_id", "name"), ["user_id", "name"], "left_anti")
    top = stored.groupBy("user_id").agg((F.max("ordinal") + 1).alias("base"))
    order = Window.partitionBy("user_id").orderBy("seed")
    new = new.join(top, "user_id", "left").withColumn("ordinal", F.coalesce("base", F.lit(0)) + F.row_number().over(order) - 1)
    new = new.select("user_id", "name", "ordinal", S.palette_index(F.col("ordinal")).alias("color"), F.lit(True).alias("is_default"), F.lit(False).alias("archived"))
    return stored.unionByName(new, allowMissingColumns=True)


def category_options(categories: DataFrame, current: str) -> DataFrame:
    """Names of active categories, with current ahead of them if it is none."""
    names = active_categories(categories).select(F.lit(1).alias("place"), "name").distinct()
    one = categories.sparkSession.range(1).select(F.lit(0).alias("place"), F.lit(current).alias("name"))
    return one.join(names.select("name"), "name", "left_anti").select("place", "name").union(names)


def wallet(accounts: DataFrame, cash: DataFrame) -> DataFrame:
    """Balance of all of a user's accounts, and the period's income less expenses."""
    total = accounts.groupBy("user_id").agg(F.sum("current_balance").alias("balance"))
    change = cash.groupBy("user_id").agg(F.sum(F.col("income") - F.col("expenses")).alias("change"))
    return total.join(change, "user_id", "left").select("user_id", "balance", F.coalesce("change", F.lit(0)).alias("change"))
