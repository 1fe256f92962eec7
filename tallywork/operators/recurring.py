"""Recurring charges, all users in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..plans.store import Table

#: What a stored subscription holds.
SUBSCRIPTION = "user_id long, merchant_norm string, merchant_name string, amount long, interval_days int, frequency string, last_date date, next_date date, active boolean"


def candidates(txn: DataFrame) -> DataFrame:
    """Settled charges with a merchant, not of a transfer."""
    name = F.coalesce("merchant_name", "merchant_norm")
    rows = txn.filter(~F.col("is_removed") & ~F.col("pending") & ~F.coalesce("exclude_from_cash_flow", F.lit(False)) & (F.col("amount") > 0))
    return rows.filter(F.length("merchant_norm") > 0).select("user_id", "tx_id", "merchant_norm", name.alias("merchant_name"), "amount", "date")


def with_ids(found: DataFrame, rows: DataFrame) -> DataFrame:
    """found with tx_ids, the charges of each subscription by date: the ids of subscriptions alone are gathered, not those of every merchant."""
    key = ["user_id", "merchant_norm"]
    of = rows.join(found.select(*key), key, "left_semi").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("date", "tx_id"))).alias("__ids"))
    return found.join(of, key).withColumn("tx_ids", F.transform("__ids", lambda x: x["tx_id"])).drop("__ids")


def recurring(rows: DataFrame, least: int = 3, band: float = 0.15, spread: float = 5.0, monthly=(30, 5), annual=(365, 20)) -> DataFrame:
    """Subscriptions of user and merchant: at least `least` charges, all within band of their median, gaps of a monthly or annual mean and little spread.

    The spread is the population's; the median of an even count is the mean of the middle two. Ties of a date go by tx_id.
    """
    key = ["user_id", "merchant_norm"]
    order = Window.partitionBy(*key).orderBy("date", "tx_id")
    gaps = rows.withColumn("gap", F.datediff("date", F.lag("date").over(order)))
    g = gaps.groupBy(*key).agg(
        F.count("*").alias("n"), F.percentile("amount", 0.5).alias("median"), F.min("amount").alias("low"), F.max("amount").alias("high"), F.avg("gap").alias("gap"), F.stddev_pop("gap").alias("dev"),
        F.max_by(F.struct("merchant_name", "amount", "date"), F.struct("date", "tx_id")).alias("last"),
    )
    same = (F.col("median") - F.col("low") <= band * F.col("median")) & (F.col("high") - F.col("median") <= band * F.col("median"))
    g = g.filter((F.col("n") >= least) & same & (F.col("dev") <= spread)).withColumn("frequency", S.frequency(F.col("gap"), *monthly, *annual)).filter("frequency is not null")
    days = F.floor(F.col("gap") + 0.5).cast("int")
    return g.select(*key, "last.merchant_name", "last.amount", days.alias("interval_days"), "frequency", F.col("last.date").alias("last_date"), F.date_add("last.date", days).alias("next_date"), "n")


def reconcile(detected: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored subscriptions after a run: detected ones are active with their new values, others that were active lapse."""
    key = ["user_id", "merchant_norm"]
    gone = stored.join(detected.select(*key), key, "left_anti").withColumn("active", F.lit(False))
    return detected.withColumn("active", F.lit(True)).unionByName(gone, allowMissingColumns=True)


def nightly(table: Table, txn: DataFrame, run: int) -> dict[str, int]:
    """A run over all users that brings the stored subscriptions up to date; detected, lapsed (by this run) and stored rows, observed on the write.

    run: the number of the run, above 0; one that is in place is not repeated.
    """
    stored, seen = table.read(), Observation()
    found = recurring(candidates(txn)).drop("n").withColumn("fresh", F.lit(True))
    before = stored.select("user_id", "merchant_norm", F.col("active").alias("was"))
    now = reconcile(found, stored).join(before, ["user_id", "merchant_norm"], "left")
    counts = F.count("fresh").alias("detected"), F.count(F.when(~F.col("active") & F.col("was"), 1)).alias("lapsed"), F.count("*").alias("stored")
    written = table.replace(now.observe(seen, *counts).select(*stored.columns), run)
    return seen.get if written else {}


def lapsed(detected: DataFrame, stored: DataFrame) -> DataFrame:
    key = ["user_id", "merchant_norm"]
    return stored.filter("active").join(detected.select(*key), key, "left_anti")


def active(stored: DataFrame) -> DataFrame:
    return stored.filter("active").orderBy("user_id", "merchant_name")
