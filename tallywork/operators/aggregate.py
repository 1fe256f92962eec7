"""Aggregates over transactions: totals, distributions, rollups, day groups, top-N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def included() -> Column:
    """Rows that cash flow counts: not removed and not excluded (an absent mark counts as included)."""
    return ~F.col("is_removed") & ~F.coalesce(F.col("exclude_from_cash_flow"), F.lit(False))


def in_range(start, end, column: str = "date") -> Column:
    """Both ends belong to it; either may be open."""
    cond = F.lit(True)
    if start is not None:
        cond &= F.col(column) >= F.lit(start)
    if end is not None:
        cond &= F.col(column) <= F.lit(end)
    return cond


def income_expenses() -> list[Column]:
    zero = F.lit(0)
    return [F.coalesce(F.sum(F.when(F.col("amount") < 0, -F.col("amount")).otherwise(zero)), zero).cast("long").alias("income"), F.coalesce(F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(zero)), zero).cast("long").alias("expenses")]


def totals(txn: DataFrame, user_id=None, start=None, end=None, account_id=None) -> DataFrame:
    """One row income, expenses; zeros where nothing matches."""
    rows = txn.filter(included() & in_range(start, end))
    if user_id is not None:
        rows = rows.filter(F.col("user_id") == user_id)
    if account_id is not None:
        rows = rows.filter(F.col("account_id") == account_id)
    return rows.agg(*income_expenses())


def spending(txn: DataFrame, start, end, income: bool = False) -> DataFrame:
    """user_id, category, total of spending (or income, its sign turned); by_total() sorts them for a reader."""
    sign = -F.col("amount") if income else F.col("amount")
    rows = txn.filter(included() & in_range(start, end) & (sign > 0))
    return rows.groupBy("user_id", F.col("category.value").alias("category")).agg(F.sum(sign).alias("total"))


def by_total(totals_: DataFrame) -> DataFrame:
    return totals_.orderBy("user_id", F.desc("total"), "category")


def spending_compared(txn: DataFrame, current, compare) -> DataFrame:
    """facet (current or compare), user_id, category, total from one scan; a row in both ranges counts in both."""
    hull = in_range(min(current[0], compare[0]), max(current[1], compare[1]))
    tags = F.array_compact(F.array(F.when(in_range(*current), F.lit("current")), F.when(in_range(*compare), F.lit("compare"))))
    rows = txn.filter(included() & hull & (F.col("amount") > 0)).withColumn("facet", F.explode(tags))
    return rows.groupBy("facet", "user_id", F.col("category.value").alias("category")).agg(F.sum("amount").alias("total"))


def monthly_rollup(txn: DataFrame) -> DataFrame:
    return txn.filter(included()).groupBy("user_id", S.month_start(F.col("date")).alias("month")).agg(*income_expenses())


def account_deltas(txn: DataFrame, after) -> DataFrame:
    """account_id, delta of settled rows strictly after a day."""
    rows = txn.filter(~F.col("is_removed") & ~F.col("pending") & (F.col("date") > F.lit(after)))
    return rows.groupBy("account_id").agg(F.sum("amount").alias("delta"))


def day_groups(txn: DataFrame, items: bool = False) -> DataFrame:
    """user_id, date, net (income positive), n_items; with items, the day's rows too."""
    listed = [F.array_sort(F.collect_list(F.struct("tx_id", "amount"))).alias("items")] if items else []
    return txn.groupBy("user_id", "date").agg((-F.sum("amount")).alias("net"), F.count("*").alias("n_items"), *listed)


def top_categories(totals_: DataFrame, top: int = 8) -> DataFrame:
    """rank, category, total, share in percent and the share before it, by user; what is past top is folded to Other."""
    order = Window.partitionBy("user_id").orderBy(F.desc("total"), "category")
    ranked = totals_.withColumn("rank", F.row_number().over(order))
    name = F.when(F.col("rank") <= top, F.col("category")).otherwise(F.lit("Other"))
    folded = ranked.groupBy("user_id", F.least("rank", F.lit(top + 1)).alias("rank"), name.alias("category")).agg(F.sum("total").alias("total"))
    whole = F.sum("total").over(Window.partitionBy("user_id"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return folded.withColumn("grand", whole).withColumn("before", before).withColumn("percent", F.floor(100 * F.col("total") / F.col("grand") + 0.5).cast("long"))


def diagnostics(txn: DataFrame, column: str) -> DataFrame:
    """One row: rows, share filled, distinct keys, keys seen more than once."""
    keys = txn.groupBy(column).agg(F.count("*").alias("n"))
    there = F.col(column).isNotNull()
    return keys.agg(
        F.sum("n").alias("n_rows"), (F.sum(F.when(there, F.col("n")).otherwise(0)) / F.sum("n")).alias("filled"), F.count(F.when(there, 1)).alias("n_keys"), F.count(F.when(there & (F.col("n") > 1), 1)).alias("n_repeated")
    )


def top_keys(txn: DataFrame, column: str, top: int = 10) -> DataFrame:
    return txn.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(top)


def touched_buckets(txn: DataFrame) -> DataFrame:
    """Distinct user_id, day, month of changed rows."""
    return txn.select("user_id", F.col("date").alias("day"), S.month_start(F.col("date")).alias("month")).distinct()


def hard_fallbacks(results: DataFrame) -> DataFrame:
    cond = (F.col("category") == "Uncategorized") & (F.col("confidence") == 0) & F.col("uncertain")
    return results.agg(F.count_if(cond).alias("n_fallbacks"), F.count("*").alias("n_results"))


def counts(**tables: DataFrame) -> DataFrame:
    """user_id and the number of its rows in each of the tables."""
    rows = None
    for name, df in tables.items():
        one = df.select("user_id", F.lit(name).alias("name"))
        rows = one if rows is None else rows.union(one)
    return rows.groupBy("user_id").agg(*(F.count_if(F.col("name") == x).alias(f"n_{x}") for x in tables))
