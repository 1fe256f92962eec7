"""No join of a table that grows with the input sends it whole through the driver."""

import datetime as dt
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.operators import categorize as C
from tallywork.sources import adapter
from tallywork.streaming import changefeed as cf
from tallywork.streaming.chain import Chain


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def broadcasts(df: DataFrame) -> list[str]:
    """The keys of the joins that are broadcasts."""
    return re.findall(r"Broadcast(?:HashJoin|NestedLoopJoin) (\[.*?\])", plan(df))


def test_batches_of_the_chain(spark, tmp_path, monkeypatch):
    """Small tables in files, which Spark would broadcast: accounts, identifiers, the index, kinds, verdicts, pairs, learned rules."""
    at = dt.date(2024, 3, 1)
    spark.createDataFrame([("p1", 1, 1), ("p2", 2, 1)], "provider_account_id string, account_id long, user_id long").write.parquet(f"{tmp_path}/accounts")
    rows = [(1, "added", i, f"t{i}", None, f"p{i % 2 + 1}", at, 10 + i, "USD", f"m {i % 3}", "d", False, None) for i in range(6)]
    removed = [(2, "removed", 0, "t1", None, None, None, None, None, None, None, None, None), (2, "added", 1, "t9", None, "p1", at, 5, "USD", "m 9", "d", False, None)]
    seen, plain = {}, Chain.put
    monkeypatch.setattr(Chain, "put", lambda self, df, name, batch: seen.update({(name, batch): broadcasts(df)}) or plain(self, df, name, batch))
    model = lambda batch: [{"tx_id": r["tx_id"], "category": "Dining", "confidence": 0.9, "uncertain": False} for r in batch]
    chain = Chain(spark, f"{tmp_path}/chain", model)
    for i, page in enumerate((rows, removed)):
        chain.batch(spark.createDataFrame(page, cf.FEED), i, spark.read.parquet(f"{tmp_path}/accounts"))
    assert {"merged", "dead", "tiered", "next_rows", "next_index", "next_rules"} <= {name for name, _ in seen}
    assert {k: [x for x in v if "provider_" in x or "tx_id" in x or "merchant_norm" in x or "pattern" in x] for k, v in seen.items() if k[0] != "kinds"} == {k: [] for k in seen if k[0] != "kinds"}
    now = {r["provider_tx_id"]: (r["is_removed"], r["category"]["value"]) for r in chain.ledger.read_all().collect()}
    assert now == {f"t{i}": (i == 1, "Dining") for i in range(6)} | {"t9": (False, "Dining")}


def test_texts_with_a_few_characters_left_out(spark, tmp_path):
    """A few bytes of texts make up to a hundred rows each, which their estimate knows nothing of."""
    spark.createDataFrame([(1, f"sub {i:05d}") for i in range(50)], "user_id long, merchant_norm string").write.parquet(f"{tmp_path}/keys")
    spark.createDataFrame([(1, f"sub {i:05d}", "A", i) for i in range(0, 50, 7)], "user_id long, normalized_merchant string, category string, ordinal int").write.parquet(f"{tmp_path}/pool")
    keys, pool = spark.read.parquet(f"{tmp_path}/keys"), spark.read.parquet(f"{tmp_path}/pool")
    found = C.similar_candidates(keys, pool)
    assert broadcasts(found) == [] and found.filter("merchant_norm = 'sub 00014' and normalized_merchant = 'sub 00014'").count() == 1
    found.collect()
    assert broadcasts(found) == []  # nor once sizes are known


def test_orders_and_customers(spark, sf):
    rows = adapter.transactions(spark, sf, dealt=True)
    assert not [x for x in broadcasts(rows) if "custkey" in x] and [x for x in broadcasts(adapter.transactions(spark, sf)) if "custkey" in x]
    n = lambda df: df.select(F.count("*"), F.sum(F.xxhash64("tx_id", "account_id", "amount", "date").cast("decimal(38,0)"))).first()
    assert n(rows) == n(adapter.transactions(spark, sf))
