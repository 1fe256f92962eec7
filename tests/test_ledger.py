"""Literal cases of the ledger operators, and every query against DuckDB on the smallest tables."""

import datetime as dt
import math
import os
import random
import runpy
import shutil
import sys
import time

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywork import catalog
from tallywork.functions import patterns as P
from tallywork.functions import ranges
from tallywork.functions import scalar as S
from tallywork.operators import aggregate as A
from tallywork.operators import categorize as C
from tallywork.operators import ledger as L
from tallywork.operators import recurring as R
from tallywork.operators import timeseries as W
from tallywork.operators import transfer as X
from tallywork.plans import store
from tallywork.streaming import changefeed as cf

D = dt.date


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in "customer orders nation supplier events".split():
        c.sql(f"create view {t} as from '{sf}/{t}.parquet'")
    return c


def same(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    got = duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(got.columns)
    order = sorted(df.columns)
    a = sorted([same(r[k]) or "" for k in order] for r in df.collect())
    b = sorted([same(r[got.columns.index(k)]) or "" for k in order] for r in got.fetchall())
    assert a == b


def test_merchant_key(spark):
    assert one(spark, S.merchant_key(F.lit("SQ *BLUE__BOTTLE   COFFEE"), F.lit("x"))) == "sq blue bottle coffee"
    assert one(spark, S.merchant_key(F.lit("  "), F.lit("Trader Joe's"))) == "trader joe s"


def test_scalars(spark):
    assert one(spark, S.to_cents(F.lit(-0.025))) == -2
    assert one(spark, S.to_cents(F.lit(None).cast("double"))) == 0
    assert one(spark, S.month_end(F.lit(D(2024, 2, 10)))) == D(2024, 2, 29)
    assert one(spark, S.week_start(F.lit(D(2024, 3, 3)))) == D(2024, 2, 26)
    assert one(spark, S.similar(F.lit("abcdefghij"), F.lit("abcdefghxy")))
    assert not one(spark, S.similar(F.lit("abcdefghij"), F.lit("abcdefgxyz")))
    assert one(spark, S.dollars(F.lit(123456), "flipped")) == "-$1,235"
    assert one(spark, S.dollars(F.lit(-123456), "explicit")) == "+$1,235"
    assert [one(spark, S.dollars(F.lit(30), x)) for x in ("plain", "flipped", "explicit")] == ["$0", "-$0", "-$0"]
    assert one(spark, S.webhook_kind(F.lit('{"webhook_type":"ITEM","webhook_code":"USER_PERMISSION_REVOKED","item_id":"i"}'))) == "item_error:revoked"
    assert one(spark, S.webhook_kind(F.lit('{"webhook_type":"ITEM","webhook_code":"ERROR","item_id":"i","error":{"error_code":"ITEM_LOGIN_REQUIRED"}}'))) == "item_error:reauth_required"
    assert one(spark, S.webhook_kind(F.lit('{"webhook_type":"ITEM","webhook_code":"PENDING_EXPIRATION"}'))) == "ignored"
    kinds = {"ITEM_LOCKED": "reauth_required", "ITEM_NOT_SUPPORTED": "revoked", "TRANSACTIONS_SYNC_MUTATION_DURING_PAGINATION": "mutation_during_pagination", "TRANSACTIONS_SYNC_CURSOR_NOT_FOUND": "invalid_cursor", "ELSE": None}
    assert {c: one(spark, S.error_kind(F.lit(None).cast("int"), F.lit(c))) for c in kinds} == kinds
    assert one(spark, S.error_kind(F.lit(400), F.lit(None).cast("string"), F.lit("RATE_LIMIT_EXCEEDED"))) == "rate_limit"
    assert one(spark, S.json_payload(F.lit('x ```json\n[1]\n``` y'))) == "[1]"
    assert one(spark, S.json_payload(F.lit('so: [{"a": 1}] ok'))) == '[{"a": 1}]'
    assert one(spark, S.webhook_kind(F.lit('{"webhook_type":"TRANSACTIONS","webhook_code":"SYNC_UPDATES_AVAILABLE","item_id":"i"}'))) == "sync"
    assert one(spark, S.webhook_kind(F.lit("no json"))) == "ignored"
    assert one(spark, S.error_kind(F.lit(429), F.lit("INVALID_CURSOR"))) == "rate_limit"
    assert one(spark, S.retry_after_ms(F.lit("30"))) == 30000
    assert one(spark, S.retry_after_ms(F.lit("soon"))) is None
    assert one(spark, S.days_requested(F.lit(None).cast("double"))) == 30
    assert one(spark, S.days_requested(F.lit(200.0))) == 90
    assert one(spark, S.synced_ago(F.lit(dt.datetime(2024, 1, 1)), F.lit(dt.datetime(2024, 1, 1, 2, 5)))) == "Synced 2h ago"
    assert one(spark, S.synced_ago(F.lit(dt.datetime(2024, 1, 1, 14, 5)), F.lit(dt.datetime(2024, 1, 9)))) == "Synced Jan 1, 2:05 PM"


def test_ranges():
    assert ranges.default_range(D(2024, 3, 9)) == (D(2023, 10, 1), D(2024, 3, 9))
    assert ranges.previous_range(D(2024, 3, 1), D(2024, 3, 31)) == (D(2024, 1, 30), D(2024, 2, 29))
    assert ranges.month_range(D(2024, 2, 9)) == (D(2024, 2, 1), D(2024, 2, 29))
    with pytest.raises(ValueError):
        ranges.checked_range("2024-01-01", "2024-02-01", "2023-01-01")
    with pytest.raises(ValueError):
        ranges.checked_page(0)


TXN = "tx_id long, user_id long, account_id long, date date, amount long, pending boolean, is_removed boolean, exclude_from_cash_flow boolean"


def test_totals(spark):
    rows = [(i, 1, 1, D(2024, 1, 5), a, False, False, None) for i, a in enumerate((-200000, 4000, 2500))]
    df = spark.createDataFrame(rows, TXN)
    assert tuple(A.totals(df).first()) == (200000, 6500)
    assert tuple(A.totals(df, user_id=9).first()) == (0, 0)


def test_snapshots(spark):
    accounts = spark.createDataFrame([(1, 1, "depository", 10000, D(2024, 1, 1)), (1, 2, "credit", 3000, D(2024, 1, 1)), (1, 3, "loan", 200000, D(2024, 1, 1)), (1, 4, "depository", 7, D(2024, 6, 1))], "user_id long, account_id long, type string, current_balance long, linked_at date")
    txn = spark.createDataFrame([(1, 1, 1, D(2024, 2, 1), 5000, False, False, None), (2, 1, 1, D(2024, 2, 2), -2000, False, False, None), (3, 1, 1, D(2024, 2, 3), 1000, False, False, True), (4, 1, 1, D(2024, 2, 3), 99, True, False, None)], TXN)
    days = spark.createDataFrame([(1, D(2024, 1, 31)), (1, D(2024, 3, 1))], "user_id long, day date")
    b = {(r["account_id"], r["day"]): r["balance"] for r in W.balances(txn, accounts, days).collect()}
    assert b[1, D(2024, 1, 31)] == 14000 and b[1, D(2024, 3, 1)] == 10000 and (4, D(2024, 3, 1)) not in b
    s = {r["date"]: r for r in W.snapshots(W.balances(txn, accounts, days)).collect()}[D(2024, 3, 1)]
    assert (s["assets"], s["liabilities"], s["net_worth"]) == (10000, 203000, -193000)


SNAP = "user_id long, date date, net_worth long, assets long, liabilities long"


def test_carry_forward(spark):
    s = spark.createDataFrame([(1, D(2024, 1, 10), 500, 500, 0), (1, D(2024, 1, 12), 900, 900, 0)], SNAP)
    got = lambda a, b: [r["net_worth"] for r in W.fill_net_worth(s, a, b).orderBy("date").collect()]
    assert got(D(2024, 1, 10), D(2024, 1, 13)) == [500, 500, 900, 900]
    assert got(D(2024, 1, 8), D(2024, 1, 11)) == [500, 500]
    assert got(D(2024, 1, 11), D(2024, 1, 11)) == [500]


def test_recurrence(spark):
    def run(days, amounts):
        rows = [(1, i, "m", "M", a, D(2024, 1, 1) + dt.timedelta(d)) for i, (d, a) in enumerate(zip(days, amounts, strict=True))]
        return R.recurring(spark.createDataFrame(rows, "user_id long, tx_id long, merchant_norm string, merchant_name string, amount long, date date")).collect()

    assert run([0, 30, 60, 90], [1599] * 4)[0]["frequency"] == "monthly"
    df = spark.createDataFrame([(1, i, "m", "M", 5, D(2024, 1, 1) + dt.timedelta(30 * (i % 4))) for i in (3, 0, 2, 1)] + [(1, 9, "other", "O", 5, D(2024, 1, 1))], "user_id long, tx_id long, merchant_norm string, merchant_name string, amount long, date date")
    assert [(r["merchant_norm"], r["tx_ids"], r["n"]) for r in R.with_ids(R.recurring(df), df).collect()] == [("m", [0, 1, 2, 3], 4)]
    assert run([0, 365, 730], [13900] * 3)[0]["frequency"] == "annual"
    assert run([0, 30, 60], [1599, 1599, 1699])[0]["amount"] == 1699
    for days, amounts in (([0, 5, 65], [1] * 3), ([0, 7, 14, 21], [5] * 4), ([0, 30], [5] * 2), ([0, 30, 60, 90], [2000, 8000, 15000, 500])):
        assert run(days, amounts) == []


def brute_pairs(rows, days=3, cents=100):
    used, out = set(), []
    for a in sorted(rows, key=lambda r: (r[4], r[1])):
        if a[1] in used or not a[3]:
            continue
        best = sorted((abs((a[4] - b[4]).days), abs(abs(a[3]) - abs(b[3])), b[1]) for b in rows if b[1] not in used and b[2] != a[2] and a[3] * b[3] < 0 and (a[5] or b[5]) and abs(abs(a[3]) - abs(b[3])) <= cents and abs((a[4] - b[4]).days) <= days)
        if best:
            used |= {a[1], best[0][2]}
            out.append((a[1], best[0][2]))
    return sorted(out)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from([-300, -200, -150, 0, 150, 201, 300]), st.integers(0, 6), st.booleans()), max_size=14))
def test_greedy_pairs(spark, raw):
    rows = [(1, i, acc, amt, D(2024, 1, 1) + dt.timedelta(day), sig) for i, (acc, amt, day, sig) in enumerate(raw)]
    df = spark.createDataFrame(rows, "user_id long, tx_id long, account_id long, amount long, date date, signal boolean")
    assert sorted((r["anchor"], r["other"]) for r in X.match(df).collect()) == brute_pairs(rows)


def test_equal_rows_are_paired_without_edges(spark):
    """Thousands of rows alike: every turn looks at one kind of partner, and pairs go by id."""
    n = 1200
    rows = [(1, i, i % 2, 500 if i % 2 else -500, D(2024, 1, 1), i % 3 == 0) for i in range(n)]
    df = spark.createDataFrame(rows, "user_id long, tx_id long, account_id long, amount long, date date, signal boolean")
    assert sorted((r["anchor"], r["other"]) for r in X.match(df).collect()) == brute_pairs(rows)
    top = X.suggestions(df, df)
    assert top.count() == 10 * n and {r["anchor"]: r["other"] for r in top.filter("rank = 1 and anchor < 2").collect()} == {0: 1, 1: 0}
    looked = []
    sweep = X.Sweep(3, 100)
    nearest = sweep.nearest
    sweep.nearest = lambda *x: looked.append(1) or nearest(*x)
    for _, tx, account, amount, _, signal in rows:
        sweep.add(0, tx, account, amount, signal)
    while sweep.turns:
        sweep.settle()
    assert len(looked) <= 4 * n


def test_runs_are_independent(spark):
    """Chains of amounts and dates over cell borders, several users, sides of one account, marks on either side."""
    rng = random.Random(5)
    rows = [(rng.randint(1, 3), i, rng.randint(1, 3), rng.choice([-1, 1]) * rng.choice([100, 150, 201, 202, 303, 404, 5000, 5100, 9999]), D(2024, 1, 1) + dt.timedelta(rng.choice([0, 1, 3, 4, 7, 8, 20, 23])), rng.random() < 0.6) for i in range(250)]
    df = spark.createDataFrame(rows, "user_id long, tx_id long, account_id long, amount long, date date, signal boolean").repartition(3)
    want = sorted(p for u in (1, 2, 3) for p in brute_pairs([r for r in rows if r[0] == u]))
    assert sorted((r["anchor"], r["other"]) for r in X.match(df).collect()) == want and len(want) > 30


def test_model_results(spark):
    df = spark.createDataFrame([(1, '```json\n[{"transactionId":"a","category":"X","confidence":0.5,"uncertain":false},{"transactionId":3,"category":"X","confidence":0.5,"uncertain":false},{"transactionId":"b","category":"X","confidence":"0.4","uncertain":false}]\n```'), (2, "nonsense"), (3, '{"a":1}')], "k int, content string")
    assert [(r["k"], r["tx_id"]) for r in C.parsed_results(df).collect()] == [(1, "a")]
    res = spark.createDataFrame([("a", "X", 0.9, False, 0), ("a", "Y", 0.8, False, 1), ("z", "X", 0.9, False, 2), ("b", " ", 0.9, False, 3)], "tx_id string, category string, confidence double, uncertain boolean, ordinal int")
    cand = spark.createDataFrame([("a",), ("b",)], "tx_id string")
    assert sorted(tuple(r) for r in C.reconcile_results(res, cand).collect()) == [("a", "Y", 0.8, False), ("b", "Uncategorized", 0.0, True)]


def test_failing_model_falls_back(spark):
    def model(batch):
        raise RuntimeError

    rows = spark.createDataFrame([(1,), (2,)], "tx_id long")
    got = C.model_tier(rows, model, []).collect()
    assert {r["status"] for r in got} == {"needs_review"} and len(got) == 2


def test_categories(spark):
    stored = spark.createDataFrame([(1, "A", 0, 0, True, False)], "user_id long, name string, ordinal long, color long, is_default boolean, archived boolean")
    seeds = spark.createDataFrame([(1, "A", 0), (1, "B", 1), (2, "A", 0)], "user_id long, name string, seed int")
    out = {(r["user_id"], r["name"]): r["ordinal"] for r in L.seed_categories(stored, seeds).collect()}
    assert out == {(1, "A"): 0, (1, "B"): 1, (2, "A"): 0}
    assert [r["name"] for r in L.category_options(stored, "Q").orderBy("place").collect()] == ["Q", "A"]


def test_store(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "k int, v string, own int")
    b = spark.createDataFrame([(2, "z", 9), (3, "w", 7)], "k int, v string, own int")
    out = {r["k"]: (r["v"], r["own"]) for r in store.upsert(a, b, ["k"], keep=("own",)).collect()}
    assert out == {1: ("x", 5), 2: ("z", 6), 3: ("w", 7)}
    p = spark.createDataFrame([(1, None, None), (2, "q", None)], "k int, v string, own int")
    assert {r["k"]: (r["v"], r["own"]) for r in store.patch(a, p, ["k"], clear=("v",)).collect()} == {1: (None, 5), 2: ("q", 6)}
    t = store.Table(spark, str(tmp_path / "t"), "k int, v string, own int")
    assert t.read().count() == 0 and t.replace(a, 1) and not t.replace(b, 1) and t.read().count() == 2
    assert t.replace(store.upsert(t.read(), b, ["k"]), 2) and t.read().count() == 3


def feed(spark, rows):
    full = [(p, op, i, tx, pend, acc, d, a, "USD", "Shop", "d", pending, None) for p, op, i, tx, pend, acc, d, a, pending in rows]
    return spark.createDataFrame(full, cf.FEED)


def test_change_feed(spark):
    accounts = spark.createDataFrame([("p1", 1, 1)], "provider_account_id string, account_id long, user_id long")
    empty = spark.createDataFrame([], cf.LEDGER)
    one_ = feed(spark, [(1, "added", 0, "a", None, "p1", D(2024, 1, 5), 10, True), (1, "added", 1, "b", None, "p1", D(2024, 1, 6), 20, False), (1, "added", 2, "x", None, "nobody", D(2024, 1, 6), 1, False), (1, "removed", 0, "never", None, "p1", None, None, None)])
    led, dead, touched = cf.apply_feed(empty, one_, accounts)
    assert {r["provider_tx_id"] for r in led.collect()} == {"a", "b"} and [r["provider_tx_id"] for r in dead.collect()] == ["x"]
    led = spark.createDataFrame(led.withColumn("category", F.when(F.col("provider_tx_id") == "a", F.struct(F.lit(4).alias("tier"), F.lit("Food").alias("value"), F.lit(None).cast("double").alias("confidence"), F.lit("confirmed").alias("status"))).otherwise(F.col("category"))).collect(), cf.LEDGER)
    two = feed(spark, [(2, "added", 0, "c", "a", "p1", D(2024, 2, 1), 10, False), (2, "modified", 0, "b", None, "p1", D(2024, 3, 1), 25, False), (3, "removed", 0, "b", None, "p1", None, None, None)])
    led2, _, touched = cf.apply_feed(led, two, accounts)
    got = {r["provider_tx_id"]: r for r in led2.collect()}
    assert got["a"]["is_removed"] and got["c"]["category"]["value"] == "Food" and got["b"]["is_removed"] and got["b"]["amount"] == 25
    assert {r["day"] for r in touched.collect()} == {D(2024, 1, 5), D(2024, 1, 6), D(2024, 2, 1), D(2024, 3, 1)}


def test_stream_equals_batch(spark, tmp_path):
    accounts = spark.createDataFrame([("p1", 1, 1)], "provider_account_id string, account_id long, user_id long")
    rows = [(p, op, i, f"t{(p * 7 + i) % 9}", None, "p1", D(2024, 1 + (p + i) % 3, 5), 10 * p + i, False) for p in range(4) for i, op in enumerate(("added", "added", "modified", "removed"))]
    for p in range(4):
        feed(spark, [r for r in rows if r[0] == p]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sync = cf.Sync(spark, str(tmp_path / "out"))
    q = sync.start(spark.readStream.schema(cf.FEED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), accounts)
    q.awaitTermination(120)
    assert q.exception() is None
    live = sync.ledger.read()
    full = A.monthly_rollup(live)
    stored = {(r["month"], r["income"], r["expenses"]) for r in sync.rollup.read().filter("income != 0 or expenses != 0").collect()}
    assert stored == {(r["month"], r["income"], r["expenses"]) for r in full.filter("income != 0 or expenses != 0").collect()}


PATTERNS = [
    (r"(?<x>store)", "a STORE", True), (r"^\d+$", "\u0661\u0662", False), (r"^\d+$", "12\n", False), (r"(?P<x>a)", "a", None), (r"a++", "aa", None), (r"(a", "a", None), (r"\b\u00e9", "\u00e9", False),
    (r"caf\b", "caf\u00e9", True), (r"a{,3}b", "a{,3}b", True), (r"[^]", "\n", True), (r"[]", "x", False), (r"x[\w-]+y", "xA-_y", True), (r"\u0041", "a", True), (r"(?<y>a)\k<y>", "xAa", True),
    (r"(a)|b\1$", "b", True), (r".", "\u2028", False), (r"\s", "\ufeff", True), (r"[\S]", "\u3000", False), (r"UBER \*TRIP", "uber *trip", True), (r"\z", "z", True), (r"s", "\u017f", False), (r"[z-a]", "b", None),
    (r"[[a]", "[", True), (r"a{2}{3}", "a", None), (r"(?=a)*b", "b", True), (r"x{2,1}", "xx", None), (r"\ca", "\x01", True), (r"\c1", "\\c1", True), (r"^*", "", None), (r"[\d-x]", "-", True), (r"]}", "]}", True), (r"(?i)a", "a", None), (r"(?<=a)*", "a", None),
]


@pytest.mark.parametrize("pattern,text,want", PATTERNS)
def test_pattern_dialect(pattern, text, want):
    found = P.translated(pattern)
    assert (None if found is None else P.found_in(found[0], text)) is want


def test_slow_pattern_is_given_up():
    began = time.time()
    assert not P.found_in(P.translated(r"^(\w+\s?)*$")[0], "a" * 50 + "!", 0.2) and time.time() - began < 5


def test_required_texts():
    want = {"store 1[0-9]": "store 1", "STORE \\d": "store ", "a|b": "", "(foo)?barbaz+qux": "barbaz", "x{0,2}yzw": "yzw", "(?!abc)d": "d", "ab?cde": "cde", "(?:abc)+": "abc", "x(?:abc|d)": "x", "(a(bcd))?e": "e", "(?<n>Shop) 7": "shop", "(?=abc)d": "d"}
    assert {p: P.translated(p)[1] for p in want} == want


def test_pattern_tier(spark):
    rows = spark.createDataFrame([(1, "Corner Shop"), (1, None), (1, "a+b"), (2, "Corner Shop"), (1, "Caf\u00e9 SHOPPE 42")], "user_id int, description string")
    rules = [("[", "Broken"), ("(?P<x>corner)", "Other dialect"), ("(?<x>corner)", "Named"), ("shop", "Retail"), (r"\+", "Plus"), (r"^.+\d{2}$", "Digits")]
    r = spark.createDataFrame([(1, "regex", p, c, n, n) for n, (p, c) in enumerate(rules)], "user_id int, match_type string, pattern string, category string, priority int, ordinal int")
    got = {(x["user_id"], x["description"]): x["tier2"] for x in C.pattern_tier(rows, r).collect()}
    assert got == {(1, "Corner Shop"): "Named", (1, None): None, (1, "a+b"): "Plus", (2, "Corner Shop"): None, (1, "Caf\u00e9 SHOPPE 42"): "Retail"}
    # Literals are looked up before any pattern is searched.
    texts = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(1, "corner 7")], "user_id int, description string")
    found = C.pattern_candidates(texts, C.pattern_rules(r.filter("pattern in ('(?<x>corner)', 'shop')")))
    assert [(x["description"], x["category"]) for x in found.collect()] == [("corner 7", "Named")]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similar_merchants_without_all_pairs(spark):
    rng = random.Random(9)
    names = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randint(1, 24))).strip() or "x" for _ in range(150)]
    keys = names[:60]
    for n in names[60:]:  # a few edits away
        x = list(n)
        for _ in range(rng.randint(0, 1 + len(x) // 5)):
            at = rng.randrange(len(x) + 1)
            x[at : at + rng.choice([0, 1])] = rng.choice(["", "z", "q"])
        keys.append("".join(x) or "y")
    pool = [(1, n, f"c{i}", i) for i, n in enumerate(names)]
    got = {r["merchant_norm"]: r["fuzzy"] for r in C.similar_tier(spark.createDataFrame([(1, k) for k in set(keys)], "user_id int, merchant_norm string"), spark.createDataFrame(pool, "user_id int, normalized_merchant string, category string, ordinal int")).collect()}
    for k in set(keys):
        fits = [(-(1 - edits(k, n) / max(len(k), len(n))), i) for i, n in enumerate(names) if 5 * edits(k, n) <= max(len(k), len(n))]
        assert got[k] == (f"c{min(fits)[1]}" if fits else None), k
    assert sum(v is not None for v in got.values()) > 60
    # What is looked at grows with the keys, not with their square.
    many = [("".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(14)),) for _ in range(2000)]
    frame = spark.createDataFrame(many, "name string").selectExpr("1 as user_id", "name as merchant_norm", "name as normalized_merchant")
    assert C.similar_candidates(frame.select("user_id", "merchant_norm"), frame.select("user_id", "normalized_merchant")).count() < 3 * len(many)


def test_short_merchants_that_share_a_word_are_not_all_pairs(spark):
    """Merchants of one form and many numbers: what they share makes no pairs, and none within a fifth of the length is lost."""
    names = [f"sub {100_000 + 997 * i}" for i in range(500)] + ["abcde", "abcd", "abcdx", "xabcd", "ab", "abcdefghij", "abcdefgh", "bcdefghijk", "abxdefyhij", "abcdefghijkl", "aacdefghij", "abcdefghijklmn", "abcdefghijklmnopq"]
    frame = spark.createDataFrame([(1, n, n) for n in names], "user_id long, merchant_norm string, normalized_merchant string")
    keys, pool = frame.select("user_id", "merchant_norm"), frame.select("user_id", "normalized_merchant")
    found = C.similar_candidates(keys, pool)
    wanted = keys.join(pool, "user_id").filter(S.similar(F.col("merchant_norm"), F.col("normalized_merchant")))
    assert wanted.join(found, wanted.columns, "left_anti").isEmpty() and wanted.count() > len(names)
    assert found.count() < 10 * len(names)


def test_rows_of_one_kind_are_looked_up_once(spark):
    schema = "user_id long, tx_id long, merchant_norm string, description string, category struct<tier:int,value:string,confidence:double,status:string>"
    none, set_ = (4, "Uncategorized", None, "needs_review"), (4, "Home", None, "confirmed")
    rows = spark.createDataFrame([(1, 1, "uber", None, none), (1, 2, "uber", None, none), (1, 3, "bar", "corner shop", none), (1, 4, "bar", "corner shop", none), (2, 5, "uber", None, none), (1, 6, "uber", None, set_), (None, 7, "uber", None, none)], schema)
    rules = spark.createDataFrame([(1, "exact", "uber", "Rides", 0, 1), (1, "regex", "shop", "Retail", 0, 2)], "user_id long, match_type string, pattern string, category string, priority int, ordinal long")
    corrected = spark.createDataFrame([], "user_id long, normalized_merchant string, category string, ordinal long")
    assert C.resolve_kinds(rows, rules, corrected).count() == 4
    got = {r["tx_id"]: (r["tier"], r["category"]) for r in C.resolve(rows, rules, corrected).collect()}
    assert got == {1: (1, "Rides"), 2: (1, "Rides"), 3: (2, "Retail"), 4: (2, "Retail"), 5: (None, None), 7: (None, None)}


def test_an_erase_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    m = store.Manifest(spark, str(tmp_path / "m"))
    m.switch({n: spark.createDataFrame([(u, f"{n}{u}") for u in (1, 2, None)], "user_id long, v string") for n in ("a", "b", "c")})
    before = m.versions()
    done, kept = [], m.read("b")

    def stops(place, text):
        done.append(place)
        raise KeyboardInterrupt

    monkeypatch.setattr(store, "write_text", stops)
    with pytest.raises(KeyboardInterrupt):
        store.erase_user(m, 1)
    monkeypatch.undo()
    assert len(done) == 1 and m.versions() == before and all(m.read(n).count() == 3 for n in before)
    assert store.erase_user(m, 1) == {"a": 1, "b": 1, "c": 1}
    assert all({r["user_id"] for r in m.read(n).collect()} == {2, None} for n in before)
    # A reader of the version before is not disturbed; what the stopped change had written has gone.
    assert kept.count() == 3 and all(len(list((tmp_path / "m" / n).iterdir())) == 2 for n in before)


def test_user_events(spark, tmp_path):
    """Two users see their own events once, also after a batch that failed half-way and one that was repeated."""
    from tallywork.streaming import sink

    place = str(tmp_path / "out")
    spark.dataSource.register(sink.UserEvents)
    jobs = spark.createDataFrame([("sync", 1, 10), ("sync", 2, 20), ("rollup", 1, 11), ("sync", 3, 30)], sink.EVENT)

    def run(df):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = spark.readStream.schema(sink.EVENT).parquet(str(tmp_path / "in")).repartition(3).writeStream.format("user_events").option("path", place).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    def seen(user, after=-1):
        return sorted(tuple(r) for r in sink.events_of(spark, place, user, after).collect())

    run(jobs)
    assert seen(1) == [("rollup", 1, 11), ("sync", 1, 10)] and seen(2) == [("sync", 2, 20)] and seen(9) == []
    w = sink.Writer(place, ["type", "user_id", "connection_id"])
    half = w.write(iter([("sync", 1, 99), ("sync", 2, 98)]))
    assert seen(1) == [("rollup", 1, 11), ("sync", 1, 10)]
    w.abort([half, None], 1)
    again = w.write(iter([("sync", 1, 10)]))
    w.commit([again, None], 0)  # its list is there already
    assert seen(1) == [("rollup", 1, 11), ("sync", 1, 10)] and not [f for m in (half, again) for _, f in m.files if (tmp_path / "out" / f).exists()]
    run(jobs.filter("user_id = 2").selectExpr("type", "user_id", "connection_id + 1 as connection_id"))
    assert seen(2) == [("sync", 2, 20), ("sync", 2, 21)] and seen(2, after=0) == [("sync", 2, 21)] and len(seen(1)) == 2


def test_webhook_stream(spark, tmp_path):
    sync = '{"webhook_type":"TRANSACTIONS","webhook_code":"SYNC_UPDATES_AVAILABLE","item_id":"%s"}'
    broken = '{"webhook_type":"ITEM","webhook_code":"ERROR","item_id":"a","error":{"error_code":"ITEM_LOCKED"}}'
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    batches = [[(sync % "a", at(0)), (sync % "a", at(1)), ("{", at(1)), ("[1]", at(1)), (sync % "b", at(2)), ('{"webhook_type":"ITEM"}', at(2))], [(sync % "a", at(5)), (broken, at(6)), (None, at(6))], [(sync % "c", at(40))], [(sync % "a", at(41))]]
    rows = spark.createDataFrame([(b, x) for b in batches for b, x in b], "body string, at timestamp")
    for b in batches:
        spark.createDataFrame(b, rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    good, bad = cf.webhooks(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    for name, df in (("good", good), ("bad", bad)):
        df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start().awaitTermination(120)
    got = sorted((r["at"].minute, r["kind"], r["item_id"]) for r in spark.read.parquet(str(tmp_path / "good")).collect())
    assert got == [(0, "sync", "a"), (2, "sync", "b"), (6, "item_error:reauth_required", "a"), (40, "sync", "c"), (41, "sync", "a")]
    assert sorted(str(r["body"]) for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["None", "[1]", "{"]


def test_many_items_share_few_states(spark, tmp_path):
    """Timers of one bucket are of different days; each transfer ages when its own has come, and no item has a state of its own."""
    from tallywork.streaming import timers

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    items = [(i % 3, f"t{i}", "transfer", day(i % 30), None) for i in range(2000)]
    closed = [(i % 3, f"t{i}", "matched", day(i % 30), None) for i in range(0, 2000, 7)]
    seen = set()
    for page, wm in ((items + closed, 29), ([(-1, "", "tick", day(60), None)], 60)):
        spark.createDataFrame(page, timers.ITEM).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        made = timers.outcomes(spark.readStream.schema(timers.ITEM).parquet(str(tmp_path / "in")))
        run = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
        seen |= {o["numRowsTotal"] for p in run.recentProgress for o in p["stateOperators"]}
        got = sorted((r["user_id"], r["item"], r["outcome"]) for r in spark.read.schema(timers.OUTCOME).parquet(str(tmp_path / "out")).collect())
        assert got == sorted((u, x, "aged") for u, x, _, at, _ in items if int(x[1:]) % 7 and at <= day(wm - 3))
    assert 0 < max(seen) <= timers.BUCKETS


def test_open_items(spark, tmp_path):
    """A pending row is met three batches later; a posted one may come first; an unmatched transfer ages by a timer, a matched one never."""
    from tallywork.streaming import timers

    day = lambda n: dt.datetime(2024, 1, n)
    batches = [
        [(1, "p", "pending", day(1), None), (1, "t", "transfer", day(1), None), (1, "m", "transfer", day(2), None), (2, "p", "pending", day(1), None)],
        [(1, "m", "matched", day(3), None), (1, "late", "posted", day(3), "y")], [(1, "u", "transfer", day(5), None), (1, "t", "transfer", day(5), None)],
        [(1, "p", "posted", day(6), "x"), (1, "late", "pending", day(6), None), (1, "p", "pending", day(6), None)], [(9, "", "tick", day(8), None)],
    ]
    seen = []
    for b in batches:
        spark.createDataFrame(b, timers.ITEM).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        made = timers.outcomes(spark.readStream.schema(timers.ITEM).parquet(str(tmp_path / "in")))
        made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
        now = sorted((r["user_id"], r["item"], r["outcome"], r["by"]) for r in spark.read.schema(timers.OUTCOME).parquet(str(tmp_path / "out")).collect())
        seen.append([x for x in now if x not in sum(seen, [])])
    assert sorted(sum(seen, []), key=str) == sorted(now, key=str) and (1, "t", "aged", None) in seen[2] and seen[3] == [(1, "late", "superseded", "y"), (1, "p", "superseded", "x")] and seen[4] == [(1, "u", "aged", None)]
    assert len(now) == 4


def test_places_of_a_hot_key(spark):
    rows = [(1 if i % 3 else None, (i * 37) % 1000, i) for i in range(1000)]
    df = store.places(spark.createDataFrame(rows, "k long, o long, v long").repartition(5), "k", "o")
    got = {r["v"]: r["place"] for r in df.collect()}
    for k in (1, None):
        mine = sorted((o, v) for x, o, v in rows if x == k)
        assert [got[v] for _, v in mine] == list(range(len(mine)))


def test_notifications_of_a_stream(spark, tmp_path):
    c = spark.createDataFrame([(10, 1), (20, 2)], "connection_id long, user_id long")
    jobs = spark.createDataFrame([("sync", 10), ("sync", 20), ("sync", 99)], "type string, connection_id long")
    jobs.write.parquet(str(tmp_path / "in"))
    out = cf.notifications(spark.readStream.schema(jobs.schema).parquet(str(tmp_path / "in")), c, 1)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("sync", 1, 10)]


def test_names_are_unique(spark):
    stored = spark.createDataFrame([(1, "A")], "user_id int, name string")
    assert store.insert_new(stored, spark.createDataFrame([(2, "A")], "user_id int, name string"), ["user_id", "name"]).count() == 2
    with pytest.raises(store.DuplicateName):
        store.insert_new(stored, stored, ["user_id", "name"])


@pytest.mark.parametrize("stop", ["ledger", "rollup", "daily"])
def test_a_stopped_batch_is_finished(spark, tmp_path, stop, monkeypatch):
    """A batch that is killed before one of its writes leaves, after a retry, what an unbroken run leaves."""
    accounts = spark.createDataFrame([("p1", 1, 1, "depository", 1000, D(2023, 1, 1))], "provider_account_id string, account_id long, user_id long, type string, current_balance long, linked_at date")
    first = feed(spark, [(1, "added", i, f"t{i}", None, "p1", D(2024, 1, 1 + i), 10 + i, False) for i in range(3)] + [(1, "added", 9, "x", None, "nobody", D(2024, 1, 6), 1, False)])
    second = feed(spark, [(2, "modified", 0, "t1", None, "p1", D(2024, 2, 1), 50, False), (3, "removed", 0, "t2", None, "p1", None, None, None)])

    def tables(sync):
        frames = (sync.ledger.read(), sync.rollup.read(), sync.daily.read(), sync.dead_letters(), sync.replay().drop("received_at"))
        return [sorted(map(str, df.collect())) for df in frames]

    whole = cf.Sync(spark, str(tmp_path / "whole"))
    whole.batch(first, 0, accounts)
    whole.batch(second, 1, accounts)
    broken = cf.Sync(spark, str(tmp_path / "broken"))
    broken.batch(first, 0, accounts)
    replace = store.Table.replace

    def dies(self, df, batch=0):
        if self.place.endswith(stop):
            raise KeyboardInterrupt
        return replace(self, df, batch)

    monkeypatch.setattr(store.Table, "replace", dies)
    with pytest.raises(KeyboardInterrupt):
        broken.batch(second, 1, accounts)
    monkeypatch.setattr(store.Table, "replace", replace)
    for _ in range(2):
        broken.batch(second, 1, accounts)
        assert tables(broken) == tables(whole)
    assert len(whole.replay("t1").collect()) == 2 and [r["amount"] for r in whole.replay("t1").collect()] == [11, 50]
    assert len(list((tmp_path / "whole" / "ledger").glob("v*"))) == 2


def test_unknown_accounts_are_refreshed_once(spark, tmp_path):
    none = spark.createDataFrame([], "provider_account_id string, account_id long, user_id long")
    calls = []

    def refresh():
        calls.append(1)
        return spark.createDataFrame([("p1", 1, 1)], none.schema)

    sync = cf.Sync(spark, str(tmp_path / "s"))
    sync.batch(feed(spark, [(1, "added", 0, "a", None, "p1", D(2024, 1, 5), 10, False), (1, "added", 1, "b", None, "p9", D(2024, 1, 5), 10, False)]), 0, none, refresh=refresh)
    assert len(calls) == 1 and [r["provider_tx_id"] for r in sync.ledger.read().collect()] == ["a"] and [r["provider_tx_id"] for r in sync.dead_letters().collect()] == ["b"]
    # A feed that touches nothing leaves no new rollup.
    before = sync.rollup.version()
    sync.batch(feed(spark, [(2, "removed", 0, "never", None, "p1", None, None, None)]), 1, none)
    assert sync.rollup.version() == before and sync.ledger.version()[1] == 2


def test_triggers_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, 1, h, m)) for k in "ab" for h in range(3) for m in range(0, 60, 7)]
    events = spark.createDataFrame(rows, "key string, at timestamp")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = cf.queue_view(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.schema(events.schema).parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in cf.queue_view(events).collect()}
    # The last window stays open in a stream.
    assert got <= want and all(t >= dt.datetime(2024, 1, 1, 2, 40) for _, t in want - got) and len(want) == 36


def test_entry_lacks_only_optional_modules(tmp_path, monkeypatch):
    path = shutil.copy(os.path.join(os.path.dirname(__file__), "..", "__spark_entry__.py"), tmp_path)
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    got = runpy.run_path(path)
    assert "pipeline" not in got["queries"]() and "ledger_view" in got["queries"]()
    monkeypatch.delitem(sys.modules, "corpus_pipeline")
    (tmp_path / "corpus_pipeline.py").write_text("import module_that_is_absent\n")
    with pytest.raises(ImportError, match="module_that_is_absent"):
        runpy.run_path(path)
