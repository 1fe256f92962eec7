"""Balances, net worth and cash flow over the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def settled(txn: DataFrame) -> DataFrame:
    """Rows that balances count; transfers are among them."""
    return txn.filter(~F.col("is_removed") & ~F.col("pending"))


def balances(txn: DataFrame, accounts: DataFrame, days: DataFrame) -> DataFrame:
    """user_id, account_id, type, day, balance at the end of day for each of days (user_id, day) and each linked account.

    balance(day) = current balance + sum of the account's amounts after day: one suffix sum over an account's days.
    """
    a = accounts.select("user_id", "account_id", "type", "current_balance", "linked_at")
    deltas = settled(txn).groupBy("account_id", F.col("date").alias("day")).agg(F.sum("amount").alias("delta"))
    wanted = days.select("user_id", "day").distinct().join(a.select("user_id", "account_id"), "user_id").select("account_id", "day", F.lit(True).alias("wanted"))
    rows = wanted.join(deltas, ["account_id", "day"], "full")
    after = Window.partitionBy("account_id").orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("later", F.coalesce(F.sum("delta").over(after), F.lit(0))).filter("wanted")
    out = rows.join(a, "account_id").filter(F.col("linked_at") <= F.col("day"))
    return out.select("user_id", "account_id", "type", "day", (F.col("current_balance") + F.col("later")).alias("balance"))


def snapshots(balances_: DataFrame, with_accounts: bool = False) -> DataFrame:
    """user_id, date, net_worth, assets, liabilities, n_accounts and, where wanted, the accounts themselves; what is owed is stored as a positive balance."""
    owed = S.is_liability(F.col("type"))
    sums = [F.sum(F.when(owed, 0).otherwise(F.col("balance"))).alias("assets"), F.sum(F.when(owed, F.col("balance")).otherwise(0)).alias("liabilities"), F.count("*").alias("n_accounts")]
    if with_accounts:
        sums.append(F.array_sort(F.collect_list(F.struct("account_id", "balance"))).alias("accounts"))
    out = balances_.groupBy("user_id", F.col("day").alias("date")).agg(*sums)
    return out.withColumn("net_worth", F.col("assets") - F.col("liabilities"))


def calendar(users: DataFrame, start, end, step: str = "1 day", name: str = "date") -> DataFrame:
    days = F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval {step})"))
    return users.select("user_id").distinct().select("user_id", days.alias(name))


def fill_net_worth(snaps: DataFrame, start, end) -> DataFrame:
    """A point a day, carried forward from the latest snapshot at or before it; days before the first are left out."""
    s = snaps.select("user_id", "date", "net_worth", "assets", "liabilities")
    seed = s.filter(F.col("date") < F.lit(start)).groupBy("user_id").agg(F.max_by(F.struct("net_worth", "assets", "liabilities"), "date").alias("v"))
    days = calendar(s, start, end).join(s.select("user_id", "date", F.struct("net_worth", "assets", "liabilities").alias("v")), ["user_id", "date"], "left")
    days = days.withColumn("seed", F.lit(0)).unionByName(seed.select("user_id", F.lit(start).cast("date").alias("date"), "v", F.lit(-1).alias("seed")))
    w = Window.partitionBy("user_id").orderBy("date", "seed").rowsBetween(Window.unboundedPreceding, 0)
    out = days.withColumn("v", F.last("v", ignorenulls=True).over(w)).filter((F.col("seed") == 0) & F.col("v").isNotNull())
    return out.select("user_id", "date", "v.*")


def latest_before(snaps: DataFrame, day) -> DataFrame:
    """The latest snapshot at or before day, by user."""
    return snaps.filter(F.col("date") <= F.lit(day)).groupBy("user_id").agg(F.max("date").alias("date"), F.max_by("net_worth", "date").alias("net_worth"))


def fill_cash_flow(rollup: DataFrame, start, end, strict_reference: bool = False) -> DataFrame:
    """A row a month with zeros where there is no rollup. strict_reference: rows before start's day don't count, as its month begins earlier."""
    month = F.trunc(F.lit(start).cast("date"), "month")
    rows = rollup.filter((F.col("month") >= (F.lit(start) if strict_reference else month)) & (F.col("month") <= F.lit(end)))
    first = start.replace(day=1)
    months = calendar(rollup, first, end.replace(day=1), "1 month", "month")
    out = months.join(rows, ["user_id", "month"], "left")
    return out.select("user_id", "month", F.coalesce("income", F.lit(0)).alias("income"), F.coalesce("expenses", F.lit(0)).alias("expenses"))


def net_of_series(cash: DataFrame) -> DataFrame:
    return cash.groupBy("user_id").agg(F.sum(F.col("income") - F.col("expenses")).alias("net"), F.max(F.greatest("income", "expenses")).alias("highest"))


def downsample(points: DataFrame, granularity: str) -> DataFrame:
    """The last point of each bucket: day, week (from Monday) or month."""
    bucket = {"day": F.col("date"), "week": S.week_start(F.col("date")), "month": S.month_start(F.col("date"))}[granularity]
    rest = [c for c in points.columns if c != "user_id"]
    out = points.groupBy("user_id", bucket.alias("bucket")).agg(F.max_by(F.struct(*rest), "date").alias("v"))
    return out.select("user_id", "bucket", "v.*")


def flag_partial(snaps: DataFrame) -> DataFrame:
    """partial: fewer accounts than the series' most."""
    most = snaps.groupBy("user_id").agg(F.max("n_accounts").alias("__most"))
    return snaps.join(most, "user_id").withColumn("partial", F.col("n_accounts") < F.col("__most")).drop("__most")


def segments(flagged: DataFrame) -> DataFrame:
    """user_id, segment, partial, date, net_worth: runs of one flag; each run also ends with the first point of the next."""
    order = Window.partitionBy("user_id").orderBy("date")
    turn = F.coalesce((F.col("partial") != F.lag("partial").over(order)).cast("int"), F.lit(0))
    rows = flagged.withColumn("turn", turn).withColumn("segment", F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    shared = rows.filter("turn = 1").select("user_id", (F.col("segment") - 1).alias("segment"), (~F.col("partial")).alias("partial"), "date", "net_worth")
    return rows.select("user_id", "segment", "partial", "date", "net_worth").unionByName(shared)


def axis_domain(points: DataFrame, pad: float = 0.1) -> DataFrame:
    """Lowest and highest net worth by user, padded by a share of their distance (of the value, where they are equal; 1 for 0)."""
    out = points.groupBy("user_id").agg(F.min("net_worth").alias("low"), F.max("net_worth").alias("high"))
    by = F.when(F.col("low") == F.col("high"), F.greatest(F.abs("high") * pad, F.lit(1.0))).otherwise((F.col("high") - F.col("low")) * pad)
    return out.select("user_id", (F.col("low") - by).alias("low"), (F.col("high") + by).alias("high"))


def latest_point(points: DataFrame) -> DataFrame:
    return points.groupBy("user_id").agg(F.max("date").alias("date"), F.max_by("net_worth", "date").alias("net_worth"))
