"""Open items as keyed state: pending rows that wait for their posted one, transfers that wait for their other side.

Items, a row each: user_id, item (a provider's identifier), kind, at (its time), by (what closes it). `pending` and `transfer` open
an item; `posted` closes the pending item that it names, `matched` closes a transfer. A pending item may wait for any time. A
transfer ages when event time has passed it by `days`. Items are kept by bucket; a bucket's first due transfer is a timer on its
state, which the watermark sets off, so a batch looks through the buckets of its rows and of what is due, not through all open
items. What comes again, or closes an item that is not open, changes nothing.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM = "user_id long, item string, kind string, at timestamp, by string"
OUTCOME = "user_id long, item string, outcome string, by string"
#: The items of a bucket as JSON: user, item, kind, due, by. Closed pending items are kept, so that a late pending row is superseded too.
STATE = "items string"
#: Buckets of items by their hash. A call into Python costs as much as a thousand items, so a state holds a bucket of some
#: thousands: a stream of very many items takes more buckets, once for its life.
BUCKETS, ITEMS = 256, 2000
DAY = 86_400_000


def outcomes(items: DataFrame, days: int = 3, delay: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """A stream of user_id, item, outcome (superseded or aged) and by (the posted row) from a stream of items."""
    def step(key, frames, state):
        now = state.getCurrentWatermarkMs()
        known = {(u, i): (kind, due, by) for u, i, kind, due, by in json.loads(state.get[0])} if state.exists else {}
        made: list[tuple] = []
        for one, kinds, at, by in grouped(frames):
            was = known.get(one)
            new, outcome = moved(was, kinds, at, by, now, days)
            if outcome:
                made.append((*one, *outcome))
            if new != was:
                known[one] = new
        for one in [x for x, (kind, due, _) in known.items() if kind == "transfer" and due is not None and due < now]:
            made.append((*one, "aged", None))
            del known[one]
        if known:
            state.update((json.dumps([(*one, *x) for one, x in known.items()]),))
            waiting = [due for kind, due, _ in known.values() if kind == "transfer" and due is not None]
            if waiting:
                state.setTimeoutTimestamp(max(min(waiting), now + 1))
        elif state.exists:
            state.remove()
        if made:
            yield pd.DataFrame([(None if u is None else int(u), *x) for u, *x in made], columns=["user_id", "item", "outcome", "by"])

    # A late item still counts: the watermark drives the timers, it drops nothing.
    timed = items.withWatermark("at", delay)
    timed = timed.select(F.pmod(F.xxhash64("user_id", "item"), F.lit(buckets)).alias("bucket"), F.col("user_id").cast("string").alias("user"), "item", "kind", "at", "by")
    return timed.groupBy("bucket").applyInPandasWithState(step, OUTCOME, STATE, "append", "EventTimeTimeout")


def grouped(frames):
    """(user, item), kinds, least time in milliseconds and least closing row of each item of the frames."""
    found: dict[tuple, list] = {}
    for pdf in frames:
        times = pdf["at"].astype("datetime64[ms]")
        for user, item, kind, at, none, by in zip(pdf["user"], pdf["item"], pdf["kind"], times.astype("int64").tolist(), times.isna(), pdf["by"], strict=True):
            x = found.setdefault((user, item), [set(), None, None])
            x[0].add(kind)
            if not none and (x[1] is None or at < x[1]):
                x[1] = at
            if kind == "posted" and by is not None and (x[2] is None or by < x[2]):
                x[2] = by
    return [(one, *x) for one, x in found.items()]


def moved(was: tuple | None, kinds: set, at: int | None, by: str | None, now: int, days: int) -> tuple:
    """(kind, due, by) of an item after what has come for it, was before, and its outcome or None."""
    kind, due, _ = was or (None, 0, None)
    if "posted" in kinds and kind != "superseded":
        waiting = kind == "pending" or "pending" in kinds
        return ("superseded" if waiting else "posted", 0, by), ("superseded", by) if waiting else None
    if "pending" in kinds and kind != "superseded":
        by = was[2] if was else None
        return ("superseded" if kind == "posted" else "pending", 0, by), ("superseded", by) if kind == "posted" else None
    if "matched" in kinds:
        return ("matched", 0, None), None
    if "transfer" in kinds and kind is None:
        # Due when the watermark has reached at + days; without a time, never.
        due = None if at is None else at + days * DAY - 1
        if due is not None and due < now:
            return ("aged", 0, None), ("aged", None)
        return ("transfer", due, None), None
    if kind == "transfer" and due is not None:
        # What has come for it in this batch goes before its timer.
        return ("transfer", max(due, now + 1), None), None
    return was, None


def transfer_items(txn: DataFrame, pairs: DataFrame) -> DataFrame:
    """The items of confirmed rows marked as transfers, and of those that have been paired."""
    from ..functions import scalar as S

    open_ = txn.filter(~F.col("is_removed") & ~F.col("pending") & F.col("transfer_group_id").isNull() & S.is_transfer_signal(F.col("provider_category")) & (F.col("category.status") == "confirmed"))
    none = F.lit(None).cast("string").alias("by")
    at = F.col("date").cast("timestamp").alias("at")
    opened = open_.select("user_id", F.col("tx_id").cast("string").alias("item"), F.lit("transfer").alias("kind"), at, none)
    sides = pairs.select("user_id", F.explode(F.array("anchor", "other")).alias("tx_id"))
    closed = open_.join(sides, ["user_id", "tx_id"], "left_semi").select("user_id", F.col("tx_id").cast("string").alias("item"), F.lit("matched").alias("kind"), at, none)
    return opened.union(closed)
