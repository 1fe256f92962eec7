"""Queries of the ledger operators over the driver's tables, with their SQL."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import aggregate as A
from .operators import categorize as C
from .operators import ledger as L
from .operators import recurring as R
from .operators import timeseries as W
from .operators import transfer as X
from .sources import adapter

D = dt.date
YEAR = (D(1998, 1, 1), D(1998, 12, 31))
BEFORE = (D(1997, 7, 1), D(1998, 6, 30))
AS_OF = D(2001, 8, 1)
QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function of the adapter's tables (named by its parameters) as a query."""

    def put(f):
        wanted = f.__code__.co_varnames[: f.__code__.co_argcount]
        makers = {"txn": adapter.transactions, "accounts": adapter.accounts, "connections": adapter.connections, "rules": adapter.rules, "categories": adapter.categories}

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(makers[w](spark, sf_dir) if w in makers else {"spark": spark, "sf_dir": sf_dir}[w] for w in wanted))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = adapter.sql(sql)
        return f

    return put


CASH = "CAST(coalesce(sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END), 0) AS BIGINT) AS income, CAST(coalesce(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END), 0) AS BIGINT) AS expenses"
IN_YEAR = "date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"


@query("spending_by_category", f" SELECT user_id, category_value AS category, CAST(sum(amount) AS BIGINT) AS total FROM txn WHERE included AND amount > 0 AND {IN_YEAR} GROUP BY 1, 2")
def _(txn):
    return A.spending(txn, *YEAR)


@query("income_by_category", f" SELECT user_id, category_value AS category, CAST(sum(-amount) AS BIGINT) AS total FROM txn WHERE included AND amount < 0 AND {IN_YEAR} GROUP BY 1, 2")
def _(txn):
    return A.spending(txn, *YEAR, income=True)


@query("largest_spending", f" SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY total DESC, category) AS INT) AS place, category, total FROM (SELECT user_id, category_value AS category, CAST(sum(amount) AS BIGINT) AS total FROM txn WHERE included AND amount > 0 AND {IN_YEAR} GROUP BY 1, 2)")
def _(txn):
    """The order of by_total(), made a column."""
    order = Window.partitionBy("user_id").orderBy("__at")
    rows = A.by_total(A.spending(txn, *YEAR)).withColumn("__at", F.monotonically_increasing_id())
    return rows.select("user_id", F.row_number().over(order).alias("place"), "category", "total")


@query(
    "spending_compared",
    f""" SELECT 'current' AS facet, user_id, category_value AS category, CAST(sum(amount) AS BIGINT) AS total FROM txn WHERE included AND amount > 0 AND {IN_YEAR} GROUP BY 2, 3
UNION ALL SELECT 'compare', user_id, category_value, CAST(sum(amount) AS BIGINT) FROM txn WHERE included AND amount > 0 AND date BETWEEN DATE '1997-07-01' AND DATE '1998-06-30' GROUP BY 2, 3""",
)
def _(txn):
    return A.spending_compared(txn, YEAR, BEFORE)


@query("transaction_totals", f" SELECT {CASH} FROM txn WHERE included")
def _(txn):
    return A.totals(txn)


@query("totals_of_account", f" SELECT {CASH} FROM txn WHERE included AND account_id = 5")
def _(txn):
    return A.totals(txn, account_id=5)


@query("monthly_rollup", f" SELECT user_id, CAST(date_trunc('month', date) AS DATE) AS month, {CASH} FROM txn WHERE included GROUP BY 1, 2")
def _(txn):
    return A.monthly_rollup(txn)


MONTHS = f"""SELECT u.user_id, m.month, coalesce(r.income, 0) AS income, coalesce(r.expenses, 0) AS expenses
FROM (SELECT DISTINCT user_id FROM txn WHERE included) u CROSS JOIN (SELECT CAST(unnest(generate_series(TIMESTAMP '1997-12-01', TIMESTAMP '2002-03-01', INTERVAL 1 MONTH)) AS DATE) AS month) m
LEFT JOIN (SELECT user_id, CAST(date_trunc('month', date) AS DATE) AS month, {CASH} FROM txn WHERE included GROUP BY 1, 2) r ON r.user_id = u.user_id AND r.month = m.month"""


@query("cash_flow_series", " " + MONTHS)
def _(txn):
    return W.fill_cash_flow(A.monthly_rollup(txn), D(1997, 12, 15), D(2002, 3, 5))


@query("cash_flow_net", f" SELECT user_id, CAST(sum(income - expenses) AS BIGINT) AS net, max(greatest(income, expenses)) AS highest FROM ({MONTHS}) GROUP BY 1")
def _(txn):
    return W.net_of_series(W.fill_cash_flow(A.monthly_rollup(txn), D(1997, 12, 15), D(2002, 3, 5)))


@query("account_deltas", " SELECT account_id, CAST(sum(amount) AS BIGINT) AS delta FROM txn WHERE NOT is_removed AND NOT pending AND date > DATE '1999-06-30' GROUP BY 1")
def _(txn):
    return A.account_deltas(txn, D(1999, 6, 30))


@query("day_groups", " SELECT user_id, date, CAST(-sum(amount) AS BIGINT) AS net, count(*) AS n_items FROM txn GROUP BY 1, 2")
def _(txn):
    return A.day_groups(txn)


TOTALS = "SELECT user_id, provider_category AS category, CAST(sum(amount) AS BIGINT) AS total FROM txn WHERE included AND amount > 0 GROUP BY 1, 2"


@query(
    "top_categories",
    f""", t AS ({TOTALS}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, category) AS rank FROM t),
g AS (SELECT user_id, least(rank, 4) AS rank, CASE WHEN rank <= 3 THEN category ELSE 'Other' END AS category, CAST(sum(total) AS BIGINT) AS total FROM r GROUP BY 1, 2, 3)
SELECT user_id, rank, category, total, CAST(sum(total) OVER (PARTITION BY user_id) AS BIGINT) AS grand, CAST(coalesce(sum(total) OVER (PARTITION BY user_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
CAST(floor(100 * total / sum(total) OVER (PARTITION BY user_id) + 0.5) AS BIGINT) AS percent FROM g""",
)
def _(txn):
    rows = txn.filter(A.included() & (F.col("amount") > 0)).groupBy("user_id", F.col("provider_category").alias("category")).agg(F.sum("amount").alias("total"))
    return A.top_categories(rows, 3).withColumn("rank", F.col("rank").cast("long"))


@query("diagnostics", " SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN merchant_name IS NOT NULL THEN n ELSE 0 END) AS DOUBLE) / sum(n) AS filled, count(merchant_name) AS n_keys, count(CASE WHEN merchant_name IS NOT NULL AND n > 1 THEN 1 END) AS n_repeated FROM (SELECT merchant_name, count(*) AS n FROM txn GROUP BY 1)")
def _(txn):
    return A.diagnostics(txn, "merchant_name")


@query("top_merchants", " SELECT merchant_norm, count(*) AS n FROM txn GROUP BY 1 ORDER BY n DESC, merchant_norm LIMIT 10")
def _(txn):
    return A.top_keys(txn, "merchant_norm")


@query("touched_buckets", " SELECT DISTINCT user_id, date AS day, CAST(date_trunc('month', date) AS DATE) AS month FROM txn WHERE pending")
def _(txn):
    return A.touched_buckets(txn.filter("pending"))


BALANCES = """, d AS (SELECT account_id, date AS day, CAST(sum(amount) AS BIGINT) AS delta FROM txn WHERE NOT is_removed AND NOT pending GROUP BY 1, 2),
days AS (SELECT DISTINCT user_id, CAST(date_trunc('month', date) AS DATE) AS day FROM txn),
bal AS (SELECT a.user_id, a.account_id, a.type, days.day, a.current_balance + CAST(coalesce(sum(d.delta), 0) AS BIGINT) AS balance
  FROM days JOIN account a USING (user_id) LEFT JOIN d ON d.account_id = a.account_id AND d.day > days.day WHERE a.linked_at <= days.day GROUP BY 1, 2, 3, 4, a.current_balance),
snap AS (SELECT user_id, day AS date, CAST(sum(CASE WHEN type IN ('credit', 'loan') THEN 0 ELSE balance END) AS BIGINT) AS assets, CAST(sum(CASE WHEN type IN ('credit', 'loan') THEN balance ELSE 0 END) AS BIGINT) AS liabilities, count(*) AS n FROM bal GROUP BY 1, 2),
net AS (SELECT *, assets - liabilities AS net_worth FROM snap)"""


def month_days(txn: DataFrame) -> DataFrame:
    return txn.select("user_id", S.month_start(F.col("date")).alias("day")).distinct()


def snaps(txn: DataFrame, accounts: DataFrame) -> DataFrame:
    return W.snapshots(W.balances(txn, accounts, month_days(txn)))


@query("account_balances", BALANCES + " SELECT * FROM bal")
def _(txn, accounts):
    return W.balances(txn, accounts, month_days(txn))


@query("balance_snapshots", BALANCES + " SELECT user_id, date, assets, liabilities, net_worth, n AS n_accounts FROM net")
def _(txn, accounts):
    return snaps(txn, accounts).select("user_id", "date", "assets", "liabilities", "net_worth", "n_accounts")


@query("net_worth_series", BALANCES + """ SELECT n.user_id, c.date, n.net_worth, n.assets, n.liabilities FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '1998-01-10', TIMESTAMP '1998-04-20', INTERVAL 1 DAY)) AS DATE) AS date) c
JOIN net n ON n.date = (SELECT max(m.date) FROM net m WHERE m.user_id = n.user_id AND m.date <= c.date)""")
def _(txn, accounts):
    return W.fill_net_worth(snaps(txn, accounts), D(1998, 1, 10), D(1998, 4, 20))


@query("latest_before", BALANCES + " SELECT user_id, max(date) AS date, arg_max(net_worth, date) AS net_worth FROM net WHERE date <= DATE '1999-05-05' GROUP BY 1")
def _(txn, accounts):
    return W.latest_before(snaps(txn, accounts), D(1999, 5, 5))


@query("net_worth_by_week", BALANCES + " SELECT user_id, CAST(date_trunc('week', date) AS DATE) AS bucket, max(date) AS date, arg_max(net_worth, date) AS net_worth FROM net GROUP BY 1, 2")
def _(txn, accounts):
    return W.downsample(snaps(txn, accounts).select("user_id", "date", "net_worth"), "week")


FLAGGED = BALANCES + ", f AS (SELECT *, n < max(n) OVER (PARTITION BY user_id) AS partial FROM net)"


@query("partial_coverage", FLAGGED + " SELECT user_id, date, partial FROM f")
def _(txn, accounts):
    return W.flag_partial(snaps(txn, accounts)).select("user_id", "date", "partial")


@query("coverage_segments", FLAGGED + """, t AS (SELECT *, CASE WHEN partial <> lag(partial) OVER w THEN 1 ELSE 0 END AS turn FROM f WINDOW w AS (PARTITION BY user_id ORDER BY date)),
s AS (SELECT *, CAST(sum(turn) OVER (PARTITION BY user_id ORDER BY date) AS BIGINT) AS segment FROM t)
SELECT user_id, segment, partial, date, net_worth FROM s UNION ALL SELECT user_id, segment - 1, NOT partial, date, net_worth FROM s WHERE turn = 1""")
def _(txn, accounts):
    return W.segments(W.flag_partial(snaps(txn, accounts)))


@query("axis_domain", BALANCES + """ SELECT user_id, lo - pad AS low, hi + pad AS high FROM (SELECT user_id, min(net_worth) AS lo, max(net_worth) AS hi,
CASE WHEN min(net_worth) = max(net_worth) THEN greatest(abs(max(net_worth)) * CAST(0.1 AS DOUBLE), 1.0) ELSE (max(net_worth) - min(net_worth)) * CAST(0.1 AS DOUBLE) END AS pad FROM net GROUP BY 1)""")
def _(txn, accounts):
    return W.axis_domain(snaps(txn, accounts))


@query("latest_point", BALANCES + " SELECT user_id, max(date) AS date, arg_max(net_worth, date) AS net_worth FROM net GROUP BY 1")
def _(txn, accounts):
    return W.latest_point(snaps(txn, accounts))


def recurring_sql(rows: str) -> str:
    return f""", c AS (SELECT user_id, tx_id, merchant_norm, coalesce(merchant_name, merchant_norm) AS merchant_name, amount, date FROM txn WHERE {rows} AND included AND NOT pending AND amount > 0 AND length(merchant_norm) > 0),
gaps AS (SELECT *, date_diff('day', lag(date) OVER w, date) AS gap FROM c WINDOW w AS (PARTITION BY user_id, merchant_norm ORDER BY date, tx_id)),
g AS (SELECT user_id, merchant_norm, count(*) AS n, median(amount) AS med, min(amount) AS lo, max(amount) AS hi, avg(gap) AS gap, stddev_pop(gap) AS dev,
  max(merchant_name) AS merchant_name, max(date) AS last_date, arg_max(amount, date_diff('day', DATE '1970-01-01', date) * 10000000000000 + tx_id) AS amount FROM (SELECT *, date_diff('day', DATE '1970-01-01', date) AS dn FROM gaps) GROUP BY 1, 2),
sub AS (SELECT *, CASE WHEN abs(gap - 30) <= 5 THEN 'monthly' WHEN abs(gap - 365) <= 20 THEN 'annual' END AS frequency FROM g
  WHERE n >= 3 AND med - lo <= CAST(0.15 AS DOUBLE) * med AND hi - med <= CAST(0.15 AS DOUBLE) * med AND dev <= 5)"""


RECURRING = recurring_sql("true")



@query("recurring_charges", RECURRING + " SELECT user_id, merchant_norm, amount, CAST(floor(gap + 0.5) AS INT) AS interval_days, frequency, last_date, last_date + CAST(floor(gap + 0.5) AS INT) AS next_date, n AS n_charges FROM sub WHERE frequency IS NOT NULL")
def _(txn):
    return R.recurring(R.candidates(txn)).select("user_id", "merchant_norm", "amount", "interval_days", "frequency", "last_date", "next_date", F.col("n").alias("n_charges"))


@query("lapsed_subscriptions", RECURRING + " SELECT DISTINCT user_id, merchant_norm FROM c ANTI JOIN (SELECT user_id, merchant_norm FROM sub WHERE frequency IS NOT NULL) s USING (user_id, merchant_norm)")
def _(txn):
    rows = R.candidates(txn)
    stored = rows.select("user_id", "merchant_norm").distinct().withColumn("active", F.lit(True))
    return R.lapsed(R.recurring(rows), stored).select("user_id", "merchant_norm")


def edges_sql(rows: str) -> str:
    return f""", p AS (SELECT user_id, tx_id, account_id, amount, date, coalesce(starts_with(provider_category, 'TRANSFER_') OR provider_category = 'LOAN_PAYMENTS_CREDIT_CARD_PAYMENT', false) AS signal FROM txn WHERE {rows} AND NOT pending AND amount <> 0),
e AS (SELECT a.user_id, a.tx_id AS anchor, a.date AS ad, b.tx_id AS other, abs(date_diff('day', a.date, b.date)) AS date_diff, abs(abs(a.amount) - abs(b.amount)) AS amount_diff, a.signal OR b.signal AS signal
  FROM p a JOIN p b ON a.user_id = b.user_id AND a.account_id <> b.account_id AND sign(a.amount) = -sign(b.amount) AND abs(abs(a.amount) - abs(b.amount)) <= 100 AND abs(date_diff('day', a.date, b.date)) <= 3)"""


EDGES = edges_sql("NOT is_removed")


@query("transfer_edges", EDGES + " SELECT user_id, anchor, other, CAST(date_diff AS INT) AS date_diff, amount_diff FROM e WHERE signal")
def _(txn):
    return X.edges(X.unmatched(txn)).drop("ad")


WALK = """, ordered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ad, anchor, date_diff, amount_diff, other) AS i FROM e WHERE signal),
walk AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS anchor, CAST(NULL AS BIGINT) AS other FROM ordered
  UNION ALL SELECT w.user_id, o.i, CASE WHEN list_contains(w.used, o.anchor) OR list_contains(w.used, o.other) THEN w.used ELSE list_concat(w.used, [o.anchor, o.other]) END,
    CASE WHEN list_contains(w.used, o.anchor) OR list_contains(w.used, o.other) THEN NULL ELSE o.anchor END, CASE WHEN list_contains(w.used, o.anchor) OR list_contains(w.used, o.other) THEN NULL ELSE o.other END
  FROM walk w JOIN ordered o ON o.user_id = w.user_id AND o.i = w.i + 1),
m AS (SELECT user_id, anchor, other FROM walk WHERE anchor IS NOT NULL)"""
MATCHES = EDGES + WALK + """,
aged AS (SELECT user_id, tx_id, 4 AS tier, category_value AS category, 'needs_review' AS status FROM txn WHERE NOT is_removed AND NOT pending AND (starts_with(provider_category, 'TRANSFER_') OR provider_category = 'LOAN_PAYMENTS_CREDIT_CARD_PAYMENT')
  AND category_status = 'confirmed' AND date <= DATE '2001-07-29' AND tx_id NOT IN (SELECT anchor FROM m UNION ALL SELECT other FROM m))"""


@query("transfer_matches", MATCHES + " SELECT * FROM m")
def _(txn):
    return X.match(X.unmatched(txn))


@query("transfer_suggestions", EDGES + " SELECT user_id, anchor, rank, other, CAST(date_diff AS INT) AS date_diff, amount_diff FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, anchor ORDER BY date_diff, amount_diff, other) AS INT) AS rank FROM e) WHERE rank <= 10")
def _(txn):
    pool = X.unmatched(txn)
    return X.suggestions(pool, pool)


@query("transfer_aging", MATCHES + " SELECT * FROM aged")
def _(txn):
    return X.aging(txn, X.match(X.unmatched(txn)), AS_OF)


@query("transfers_aged_by_timer", MATCHES + " SELECT user_id, CAST(tx_id AS VARCHAR) AS item, 'aged' AS outcome FROM aged")
def _(txn):
    """The same rows by timers of a stream that has come to AS_OF: two pages of rows, then time alone goes on."""
    from .plans.store import shared_place
    from .streaming.timers import BUCKETS, ITEM, ITEMS, outcomes, transfer_items

    spark = txn.sparkSession
    place = shared_place(spark, "timers")
    # Stored, as both pages are made from them.
    transfer_items(txn, X.match(X.unmatched(txn))).filter(F.col("at") <= F.lit(AS_OF)).write.parquet(f"{place}/items")
    items = spark.read.schema(ITEM).parquet(f"{place}/items")
    buckets = max(BUCKETS, -(-items.count() // ITEMS))
    tick = spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit("").alias("item"), F.lit("tick").alias("kind"), F.lit(AS_OF).cast("timestamp").alias("at"), F.lit(None).cast("string").alias("by"))
    for page in (items.filter("at < '1998-01-01'"), items.filter("at >= '1998-01-01'"), tick):
        page.write.mode("append").parquet(f"{place}/in")
        made = outcomes(spark.readStream.schema(ITEM).option("maxFilesPerTrigger", 1_000_000).parquet(f"{place}/in"), X.DAYS, buckets=buckets)
        run = made.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{place}/out").select("user_id", "item", "outcome")


@query("transfer_counts", MATCHES + """ SELECT user_id, count(*) AS candidates, coalesce(any_value(n_m), 0) AS matched, coalesce(any_value(n_a), 0) AS aged FROM txn LEFT JOIN (SELECT user_id, count(*) AS n_m FROM m GROUP BY 1) USING (user_id)
LEFT JOIN (SELECT user_id, count(*) AS n_a FROM aged GROUP BY 1) USING (user_id) WHERE NOT is_removed AND NOT pending GROUP BY 1""")
def _(txn):
    pool = X.unmatched(txn)
    pairs = X.match(pool)
    return X.run_counts(pool, pairs, X.aging(txn, pairs, AS_OF))


@query("transfer_links", MATCHES + " SELECT user_id, anchor AS tx_id, 'g-' || anchor AS transfer_group_id FROM m UNION ALL SELECT user_id, other, 'g-' || anchor FROM m")
def _(txn):
    return X.link(txn, X.match(X.unmatched(txn))).filter("transfer_group_id is not null").select("user_id", "tx_id", "transfer_group_id")


def tiers_sql(rows: str) -> str:
    return f""", o AS (SELECT user_id, tx_id, merchant_norm, description FROM txn WHERE {rows}),
t1 AS (SELECT user_id, pattern AS merchant_norm, arg_max(category, ordinal) AS tier1 FROM rule WHERE match_type = 'exact' GROUP BY 1, 2),
t2 AS (SELECT d.user_id, d.description, arg_min(r.category, r.priority * 1000 + r.ordinal) AS tier2 FROM (SELECT DISTINCT user_id, description FROM o) d JOIN (SELECT * FROM rule WHERE match_type = 'regex' AND pattern <> 'store (') r ON r.user_id = d.user_id AND regexp_matches(d.description, replace(r.pattern, '(?<', '(?P<'), 'i') GROUP BY 1, 2),
cm AS (SELECT user_id, merchant_norm AS m, arg_min(category_value, tx_id) AS category, min(tx_id) AS ordinal FROM txn WHERE category_tier = 4 AND category_status = 'confirmed' AND length(merchant_norm) > 0 GROUP BY 1, 2),
fz AS (SELECT user_id, merchant_norm, category AS fuzzy FROM (SELECT k.user_id, k.merchant_norm, cm.category, row_number() OVER (PARTITION BY k.user_id, k.merchant_norm ORDER BY 1 - levenshtein(k.merchant_norm, cm.m) / CAST(greatest(length(k.merchant_norm), length(cm.m)) AS DOUBLE) DESC, cm.ordinal) AS rn
  FROM (SELECT DISTINCT user_id, merchant_norm FROM o) k JOIN cm ON cm.user_id = k.user_id AND 5 * levenshtein(k.merchant_norm, cm.m) <= greatest(length(k.merchant_norm), length(cm.m))) WHERE rn = 1)"""


TIERS = tiers_sql("category_tier = 4 AND category_value = 'Uncategorized' AND category_status = 'needs_review'")


@query("categorized", TIERS + " SELECT o.user_id, o.tx_id, CASE WHEN tier1 IS NOT NULL THEN 1 WHEN coalesce(tier2, fuzzy) IS NOT NULL THEN 2 END AS tier, coalesce(tier1, tier2, fuzzy) AS category FROM o LEFT JOIN t1 ON t1.user_id = o.user_id AND t1.merchant_norm = o.merchant_norm LEFT JOIN t2 ON t2.user_id = o.user_id AND t2.description = o.description LEFT JOIN fz ON fz.user_id = o.user_id AND fz.merchant_norm = o.merchant_norm")
def _(txn, rules):
    return C.resolve(txn, rules, C.corrected_merchants(txn))


def stub_model(batch: list[dict]) -> list[dict]:
    """A deterministic stand-in for a model."""
    return [{"tx_id": r["tx_id"], "category": "Dining" if r["tx_id"] % 20 else "", "confidence": (r["tx_id"] // 10 % 100) / 100, "uncertain": r["tx_id"] // 10 % 5 == 0} for r in batch]


@query("model_tier", """ SELECT tx_id, CASE WHEN tx_id % 20 > 0 THEN 'Dining' ELSE 'Uncategorized' END AS category, CASE WHEN tx_id % 20 > 0 THEN CAST(CAST(tx_id AS BIGINT) // 10 % 100 AS DOUBLE) / 100 ELSE 0 END AS confidence, tx_id % 20 = 0 OR tx_id // 10 % 5 = 0 AS uncertain,
CASE WHEN tx_id % 20 = 0 OR tx_id // 10 % 5 = 0 OR CAST(tx_id // 10 % 100 AS DOUBLE) / 100 < CAST(0.7 AS DOUBLE) THEN 'needs_review' ELSE 'confirmed' END AS status FROM txn WHERE category_status = 'needs_review'""")
def _(txn):
    rows = txn.filter("category.status = 'needs_review'").select("tx_id", "merchant_norm", "description", "amount")
    return C.model_tier(rows, stub_model, ["Dining", "Uncategorized"])


@query("rule_write_back", " SELECT user_id, 1 AS tier, 'exact' AS match_type, merchant_norm AS pattern, arg_max(category_value, tx_id) AS category, 0 AS priority, 'llm' AS source FROM txn WHERE category_status = 'confirmed' AND length(merchant_norm) > 0 GROUP BY 1, 4")
def _(txn):
    return C.write_back(txn.select("user_id", "merchant_norm", F.col("category.value").alias("category"), F.col("category.status").alias("status"), F.col("tx_id").alias("ordinal")), "llm")


@query("prompts", """ SELECT user_id, batch, 'Categories: Dining, Uncategorized' || chr(10) || string_agg(line, chr(10) ORDER BY tx_id) AS prompt FROM (SELECT user_id, tx_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY tx_id) - 1 AS BIGINT) // 30 AS batch,
printf('%s | %s | %s | %.2f USD', CAST(tx_id AS VARCHAR), coalesce(merchant_name, ''), description, amount / 100.0) AS line FROM txn WHERE category_status = 'needs_review') GROUP BY 1, 2""")
def _(txn):
    return C.prompt_lines(txn.filter("category.status = 'needs_review'"), ["Dining", "Uncategorized"])


@query("verdicts_merged", """ SELECT user_id, tx_id, CASE WHEN by_hand THEN 4 WHEN open THEN 3 ELSE category_tier END AS tier, CASE WHEN by_hand THEN 'Mine' WHEN open THEN CASE WHEN tx_id % 20 > 0 THEN 'Dining' ELSE 'Uncategorized' END ELSE category_value END AS value,
CASE WHEN by_hand THEN 'confirmed' WHEN open THEN CASE WHEN tx_id % 20 = 0 OR tx_id // 10 % 5 = 0 OR CAST(tx_id // 10 % 100 AS DOUBLE) / 100 < CAST(0.7 AS DOUBLE) THEN 'needs_review' ELSE 'confirmed' END ELSE category_status END AS status
FROM (SELECT *, category_status = 'needs_review' AS open, category_status = 'needs_review' AND tx_id % 3 = 0 AS by_hand FROM txn)""")
def _(txn):
    """Verdicts for all rows that needed a review; of these, every third has been set by hand meanwhile, which stays."""
    open_ = txn.filter("category.status = 'needs_review'")
    verdicts = C.model_tier(open_.select("tx_id", "merchant_norm", "description", "amount"), stub_model, ["Dining", "Uncategorized"])
    meanwhile = C.set_category(txn, open_.filter("tx_id % 3 = 0").select("user_id", "tx_id", F.lit("Mine").alias("value")))
    return C.merge_verdicts(meanwhile, verdicts).select("user_id", "tx_id", "category.tier", "category.value", "category.status")


@query("categories_set", " SELECT user_id, tx_id, CASE WHEN tx_id % 4 = 0 THEN 4 ELSE category_tier END AS tier, CASE WHEN tx_id % 4 = 0 THEN 'Mine' ELSE category_value END AS value, CASE WHEN tx_id % 4 = 0 THEN 'confirmed' ELSE category_status END AS status FROM txn")
def _(txn):
    """Changes of own rows, and of rows of other users, which stay."""
    own = txn.filter("tx_id % 4 = 0").select("user_id", "tx_id", F.lit("Mine").alias("value"))
    others = txn.filter("tx_id % 4 = 1").select((F.col("user_id") + 1).alias("user_id"), "tx_id", F.lit("Not mine").alias("value"))
    return C.set_category(txn, own.union(others)).select("user_id", "tx_id", "category.tier", "category.value", "category.status")


@query("hard_fallbacks", " SELECT count(CASE WHEN tx_id % 20 = 0 THEN 1 END) AS n_fallbacks, count(*) AS n_results FROM txn WHERE category_status = 'needs_review'")
def _(txn):
    rows = txn.filter("category.status = 'needs_review'").select("tx_id", "merchant_norm", "description", "amount")
    return A.hard_fallbacks(C.model_tier(rows, stub_model, ["Dining", "Uncategorized"]))


@query("active_categories", " SELECT user_id, name, ordinal FROM cat WHERE NOT archived")
def _(categories):
    return L.active_categories(categories).select("user_id", "name", "ordinal")


@query("category_sections", " SELECT user_id, name, CASE WHEN NOT is_default THEN 'custom' WHEN kind = 'income' THEN 'default-income' ELSE 'default-expense' END AS section FROM cat")
def _(categories):
    return L.category_groups(categories).select("user_id", "name", "section")


@query("category_styles", f" SELECT t.*, color, icon FROM (SELECT user_id, category_value AS category, CAST(sum(amount) AS BIGINT) AS total FROM txn WHERE included AND amount > 0 AND {IN_YEAR} GROUP BY 1, 2) t LEFT JOIN cat ON cat.user_id = t.user_id AND cat.name = t.category")
def _(txn, categories):
    return L.with_category_style(A.spending(txn, *YEAR), categories).select("user_id", "category", "total", "color", "icon")


@query("account_types", " SELECT account_id, CASE WHEN type = 'investment' AND account_id % 2 = 0 THEN 'investment' WHEN account_id % 13 = 0 THEN 'depository' ELSE type END AS kind, CASE WHEN account_id % 3 = 0 THEN 'EUR' WHEN account_id % 3 = 1 THEN 'XBT' ELSE 'USD' END AS currency FROM account")
def _(accounts):
    told = F.when((F.col("type") == "investment") & (F.col("account_id") % 2 == 0), "brokerage").when(F.col("account_id") % 13 == 0, "other").otherwise(F.col("type"))
    iso, other = F.when(F.col("account_id") % 3 == 0, "EUR"), F.when(F.col("account_id") % 3 < 2, "XBT")
    return accounts.select("account_id", S.account_type(told).alias("kind"), S.currency(iso, other).alias("currency"))


@query("account_by_id", " SELECT account_id, type FROM account WHERE account_id = 5")
def _(accounts):
    return L.by_id(accounts, "account_id", "5").union(L.by_id(accounts, "account_id", "not an id")).select("account_id", "type")


@query("transactions_by_date", f" SELECT tx_id, date, amount FROM txn WHERE user_id = 3 AND NOT is_removed AND {IN_YEAR}")
def _(txn):
    return L.by_date(txn, 3, *YEAR).select("tx_id", "date", "amount")


@query("syncable_connections", " SELECT user_id, connection_id FROM connection WHERE status = 'active'")
def _(connections):
    return L.syncable(connections).select("user_id", "connection_id")


@query("connection_states", " SELECT connection_id, CASE connection_id % 6 WHEN 1 THEN 'login_required' WHEN 2 THEN 'error' ELSE status END AS status FROM connection")
def _(connections):
    """Connections after errors of several kinds: only two of them are terminal."""
    code = F.element_at(F.array(*map(F.lit, ("RATE_LIMIT_EXCEEDED", "ITEM_LOCKED", "ITEM_NOT_SUPPORTED", "INVALID_CURSOR", "TRANSACTIONS_SYNC_MUTATION_DURING_PAGINATION", "OTHER"))), (F.col("connection_id") % 6 + 1).cast("int"))
    errors = connections.select("connection_id", S.error_kind(F.lit(400), code, F.lit("ITEM_ERROR")).alias("kind"))
    return L.after_errors(connections, errors).select("connection_id", "status")


@query("webhook_kinds", """ SELECT connection_id, CASE connection_id % 8 WHEN 0 THEN 'sync' WHEN 1 THEN 'item_error:reauth_required' WHEN 2 THEN 'item_error:reauth_required' WHEN 3 THEN 'item_error:revoked' WHEN 4 THEN 'item_error:revoked' ELSE 'ignored' END AS kind FROM connection""")
def _(connections):
    kinds = [("TRANSACTIONS", "SYNC_UPDATES_AVAILABLE", ""), ("ITEM", "PENDING_EXPIRATION", ""), ("ITEM", "ERROR", "ITEM_LOCKED"), ("ITEM", "USER_PERMISSION_REVOKED", ""), ("ITEM", "ERROR", "ACCESS_NOT_GRANTED"), ("ITEM", "ERROR", "SOMETHING"), ("ITEM", "PENDING_DISCONNECT", ""), ("TRANSACTIONS", "DEFAULT_UPDATE", "")]
    body = F.element_at(F.array(*(F.struct(F.lit(a).alias("webhook_type"), F.lit(b).alias("webhook_code"), F.struct(F.lit(c).alias("error_code")).alias("error")) for a, b, c in kinds)), (F.col("connection_id") % 8 + 1).cast("int"))
    text = F.to_json(F.struct(body["webhook_type"].alias("webhook_type"), body["webhook_code"].alias("webhook_code"), body["error"].alias("error"), F.col("provider_item_id").alias("item_id")))
    return connections.select("connection_id", S.webhook_kind(text).alias("kind"))


@query("synced_labels", """ SELECT connection_id, CASE WHEN last_synced_at IS NULL THEN 'Never synced yet' WHEN m < 1 THEN 'Synced just now' WHEN m < 60 THEN 'Synced ' || m || 'm ago' WHEN m < 1440 THEN 'Synced ' || m // 60 || 'h ago' ELSE strftime(t, 'Synced %b %-d, %-I:%M %p') END AS label
FROM (SELECT *, CAST(date_diff('second', t, TIMESTAMP '2001-08-01 10:30:00') AS BIGINT) // 60 AS m FROM (SELECT *, CAST(last_synced_at AS TIMESTAMP) + to_minutes(CAST(connection_id * 37 AS BIGINT)) AS t FROM connection))""")
def _(connections):
    at = F.col("last_synced_at").cast("timestamp") + F.make_dt_interval(mins=(F.col("connection_id") * 37).cast("int"))
    return connections.select("connection_id", S.synced_ago(at, F.lit("2001-08-01 10:30:00").cast("timestamp")).alias("label"))


@query("user_by_email", " SELECT user_id, email FROM (SELECT DISTINCT user_id, concat('user', user_id, '@example.org') AS email FROM account) WHERE user_id = 7")
def _(accounts):
    users = accounts.select("user_id", F.concat(F.lit("user"), "user_id", F.lit("@example.org")).alias("email")).distinct()
    return L.by_email(users, "User7@Example.ORG")


@query("accounts_renamed", """ SELECT account_id, user_id, CASE WHEN account_id % 4 = 0 THEN concat('Account ', account_id) WHEN account_id % 10 <> 5 THEN nickname END AS nickname, CASE WHEN account_id % 3 = 0 THEN true ELSE archived END AS archived FROM account""")
def _(accounts):
    """Names set, names cleared, accounts archived; the same asked for by users who don't own them changes nothing."""
    mine = F.when(F.col("account_id") % 4 == 0, F.concat(F.lit("Account "), "account_id")).alias("nickname")
    own = accounts.filter("account_id % 4 = 0 or account_id % 10 = 5").select("user_id", "account_id", mine)
    others = accounts.filter("account_id % 4 = 1 and account_id % 10 != 5").select((F.col("user_id") + 1).alias("user_id"), "account_id", F.lit("Not mine").alias("nickname"))
    chosen = accounts.filter("account_id % 3 = 0").select("user_id", "account_id").union(accounts.filter("account_id % 3 = 1").select(F.col("user_id") + 1, "account_id"))
    return L.archive_accounts(L.rename_accounts(accounts, own.union(others)), chosen).select("account_id", "user_id", "nickname", "archived")


@query("user_ids", " SELECT DISTINCT user_id FROM (SELECT user_id FROM account UNION ALL SELECT user_id FROM connection)")
def _(accounts, connections):
    return L.user_ids(accounts, connections)


@query("user_counts", " SELECT user_id, CAST(sum(a) AS BIGINT) AS n_accounts, CAST(sum(c) AS BIGINT) AS n_connections, CAST(sum(t) AS BIGINT) AS n_transactions FROM (SELECT user_id, 1 AS a, 0 AS c, 0 AS t FROM account UNION ALL SELECT user_id, 0, 1, 0 FROM connection UNION ALL SELECT user_id, 0, 0, 1 FROM txn) GROUP BY 1")
def _(accounts, connections, txn):
    return A.counts(accounts=accounts, connections=connections, transactions=txn)


@query("active_subscriptions", RECURRING + " SELECT user_id, merchant_norm FROM sub WHERE frequency IS NOT NULL")
def _(txn):
    """After a run over stored subscriptions, of which those not found any more have lapsed."""
    rows = R.candidates(txn)
    found = R.recurring(rows).select("user_id", "merchant_norm", "merchant_name", "amount")
    stored = rows.groupBy("user_id", "merchant_norm").agg(F.max("merchant_name").alias("merchant_name"), F.max("amount").alias("amount")).withColumn("active", F.lit(True))
    return R.active(R.reconcile(found, stored)).select("user_id", "merchant_norm")


@query(
    "nightly_subscriptions",
    RECURRING + """, early AS (SELECT user_id, merchant_norm FROM (SELECT user_id, merchant_norm, count(*) AS n, median(amount) AS med, min(amount) AS lo, max(amount) AS hi, avg(gap) AS gap, stddev_pop(gap) AS dev
  FROM (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY user_id, merchant_norm ORDER BY date, tx_id), date) AS gap FROM c WHERE date <= DATE '1997-09-01') GROUP BY 1, 2)
  WHERE n >= 3 AND med - lo <= CAST(0.15 AS DOUBLE) * med AND hi - med <= CAST(0.15 AS DOUBLE) * med AND dev <= 5 AND (abs(gap - 30) <= 5 OR abs(gap - 365) <= 20)),
late AS (SELECT user_id, merchant_norm FROM sub WHERE frequency IS NOT NULL)
SELECT user_id, merchant_norm, l.user_id IS NOT NULL AS active, CAST((SELECT count(*) FROM late) AS BIGINT) AS detected, CAST((SELECT count(*) FROM early ANTI JOIN late USING (user_id, merchant_norm)) AS BIGINT) AS lapsed
FROM early e FULL JOIN late l USING (user_id, merchant_norm)""",
)
def _(txn):
    """Stored subscriptions after two nights, the first over the rows up to a day; with the second run's counters."""
    from .plans.store import Table, shared_place

    table = Table(txn.sparkSession, shared_place(txn.sparkSession, "subscriptions"), R.SUBSCRIPTION)
    R.nightly(table, txn.filter("date <= date'1997-09-01'"), 1)
    n = R.nightly(table, txn, 2)
    return table.read().select("user_id", "merchant_norm", "active", F.lit(n["detected"]).cast("long").alias("detected"), F.lit(n["lapsed"]).cast("long").alias("lapsed"))


@query("notified", " SELECT 'sync' AS type, c.user_id, c.connection_id FROM connection c")
def _(connections):
    """Finished jobs of every connection, and of one that nobody has, as each user sees them."""
    from .streaming.changefeed import notifications

    jobs = connections.select(F.lit("sync").alias("type"), "connection_id").union(connections.sparkSession.sql("select 'sync' as type, -1L as connection_id"))
    return notifications(jobs, connections)


@query("ledger_view", """ SELECT t.user_id, tx_id, date, amount, coalesce(merchant_override, merchant_name, merchant_norm) AS merchant, description, pending, category_value AS category, category_status AS status, category_tier AS tier, false AS is_transfer,
CASE WHEN a.account_id IS NULL THEN 'Unknown account' ELSE coalesce(nickname, official_name, institution_name) END AS account_name, coalesce(a.type, '') AS account_type FROM txn t LEFT JOIN account a USING (account_id)""")
def _(txn, accounts):
    return L.ledger_view(txn, accounts)


@query("ledger_page", " SELECT tx_id, date, amount FROM txn WHERE user_id = 3 AND NOT is_removed AND category_status = 'confirmed' AND date >= DATE '1996-01-01' ORDER BY date DESC, tx_id LIMIT 25 OFFSET 50")
def _(txn):
    return L.page(txn, 3, 3, 25, status="confirmed", start=D(1996, 1, 1))[0].select("tx_id", "date", "amount")


@query("pages_have_more", " SELECT n AS page, (SELECT count(*) FROM txn WHERE user_id = 3 AND NOT is_removed AND category_status = 'needs_review') > n * 40 AS has_more FROM unnest([1, 2, 3, 4, 5]) AS t(n)")
def _(txn):
    pages = [L.page(txn, 3, n, 40, status="needs_review")[1].select(F.lit(n).alias("page"), "has_more") for n in range(1, 6)]
    return reduce(DataFrame.union, pages)


@query("review_queue", " SELECT user_id, tx_id, amount FROM txn WHERE NOT is_removed AND category_status = 'needs_review'")
def _(txn):
    return L.needs_review(txn).select("user_id", "tx_id", "amount")


@query("account_list", " SELECT account_id, institution_name, subtype, coalesce(status, 'error') AS status, last_synced_at FROM account LEFT JOIN connection USING (connection_id) WHERE NOT coalesce(archived, false)")
def _(accounts, connections):
    return L.account_list(accounts, connections).select("account_id", "institution_name", "subtype", "status", "last_synced_at")


@query("wallets", f", m AS (SELECT user_id, {CASH} FROM txn WHERE included AND {IN_YEAR} GROUP BY 1) SELECT user_id, CAST(sum(current_balance) AS BIGINT) AS balance, CAST(coalesce(max(m.income - m.expenses), 0) AS BIGINT) AS change FROM account LEFT JOIN m USING (user_id) GROUP BY 1")
def _(txn, accounts):
    cash = txn.filter(A.included() & A.in_range(*YEAR)).groupBy("user_id").agg(*A.income_expenses())
    return L.wallet(accounts, cash)


@query("small_money", """ SELECT o_orderkey AS k, CASE WHEN c < 0 THEN '-' ELSE '' END || '$' || u AS plain, CASE WHEN c > 0 THEN '-' ELSE '' END || '$' || u AS flipped, CASE WHEN c < 0 THEN '+' WHEN c > 0 THEN '-' ELSE '' END || '$' || u AS explicit
FROM (SELECT o_orderkey, c, CAST(floor(abs(c) / 100 + 0.5) AS BIGINT) AS u FROM (SELECT o_orderkey, o_orderkey % 301 - 150 AS c FROM orders))""")
def _(spark, sf_dir):
    """Amounts around nothing, whose sign stays when they round to $0."""
    c = F.col("o_orderkey") % 301 - 150
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), *(S.dollars(c, x).alias(x) for x in ("plain", "flipped", "explicit")))


@query("money_labels", """ SELECT tx_id, CASE WHEN amount < 0 THEN '-' ELSE '' END || '$' || format('{:,}', CAST(floor(abs(amount) / 100 + 0.5) AS BIGINT)) AS label, strftime(date, '%b %-d') AS day_label, strftime(date, '%b %y') AS month_label,
CAST(date_trunc('week', date) AS DATE) AS week, last_day(date) AS month_end FROM txn""")
def _(txn):
    d = F.col("date")
    return txn.select("tx_id", S.dollars(F.col("amount")).alias("label"), S.day_label(d).alias("day_label"), S.month_label(d).alias("month_label"), S.week_start(d).alias("week"), S.month_end(d).alias("month_end"))


@query("cents", " SELECT o_orderkey AS k, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents FROM orders")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), S.to_cents(F.col("o_totalprice")).alias("cents"))


@query("erased", """ SELECT 'txn' AS name, user_id, count(*) AS n FROM txn WHERE user_id <> 3 GROUP BY 2 UNION ALL SELECT 'accounts', user_id, count(*) FROM account WHERE user_id <> 3 GROUP BY 2
UNION ALL SELECT 'connections', user_id, count(*) FROM connection WHERE user_id <> 3 GROUP BY 2 UNION ALL SELECT 'rules', user_id, count(*) FROM rule WHERE user_id <> 3 GROUP BY 2 UNION ALL SELECT 'categories', user_id, count(*) FROM cat WHERE user_id <> 3 GROUP BY 2""")
def _(txn, accounts, connections, rules, categories):
    """What all stored tables hold once a user has been erased from them."""
    from .plans.store import Manifest, erase_user, shared_place

    store = Manifest(txn.sparkSession, shared_place(txn.sparkSession, "erase"))
    store.switch({"txn": txn.select("user_id", "tx_id"), "accounts": accounts.select("user_id", "account_id"), "connections": connections.select("user_id", "connection_id"), "rules": rules.select("user_id", "pattern"), "categories": categories.select("user_id", "name")})
    erase_user(store, 3)
    return reduce(DataFrame.union, [store.read(n).groupBy("user_id").count().select(F.lit(n).alias("name"), "user_id", F.col("count").alias("n")) for n in store.versions()])


@query("trigger_events", " SELECT event_type AS key, min(ts) AS at FROM events GROUP BY event_type, CAST(floor(epoch(ts) / 600) AS BIGINT)")
def _(spark, sf_dir):
    from .streaming.changefeed import queue_view

    return queue_view(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("key"), F.col("ts").alias("at")))


@query(
    "feed_applied",
    """, known AS (SELECT *, tx_id % 5 = 1 AS stored, tx_id % 20 = 10 AND tx_id < 1000000000000 AS posted FROM txn WHERE account_id % 11 <> 0),
own AS (SELECT lpad(CAST(tx_id AS VARCHAR), 20, '0') AS provider_tx_id, user_id, CASE WHEN tx_id % 50 = 0 THEN amount + 1 ELSE amount END AS amount, tx_id % 70 = 0 AS is_removed,
    CASE WHEN posted AND category_status = 'confirmed' THEN category_value WHEN stored AND NOT posted THEN category_value ELSE 'Uncategorized' END AS value FROM known)
SELECT * FROM own UNION ALL SELECT 'p' || lpad(CAST(tx_id AS VARCHAR), 20, '0'), user_id, amount - 7, true, category_value FROM known WHERE posted""",
)
def _(txn, accounts):
    """A stored ledger with some of the rows and, of others, the pending ones; then pages of new, posted, changed and removed rows. Rows of unknown accounts change nothing.

    A posted row removes the pending one that it names and takes over its category, unless that is none.
    """
    from .streaming.changefeed import FEED, LEDGER, apply_feed

    spark = txn.sparkSession
    tx, posted = F.lpad(F.col("tx_id").cast("string"), 20, "0"), "tx_id % 20 = 10 and tx_id < 1000000000000"
    shape = spark.createDataFrame([], LEDGER)
    mine = txn.filter("account_id % 11 != 0").withColumns({"provider_tx_id": tx, "pending_tx_id": F.lit(None).cast("string"), "currency": F.lit("USD"), "pending": F.lit(False), "is_removed": F.lit(False)})
    stored = mine.filter(f"tx_id % 5 = 1 and not ({posted})").select(shape.columns)
    waiting = mine.filter(posted).withColumns({"provider_tx_id": F.concat(F.lit("p"), tx), "amount": F.col("amount") - 7, "pending": F.lit(True)}).select(shape.columns)

    def rows(of: DataFrame, page: int, op: str, more: int = 0) -> DataFrame:
        named = F.when(F.expr(posted), F.concat(F.lit("p"), tx)).alias("pending_tx_id")
        head = [F.lit(page).cast("long").alias("page"), F.lit(op).alias("op"), F.col("tx_id").alias("idx"), tx.alias("provider_tx_id"), named, F.col("account_id").cast("string").alias("provider_account_id")]
        return of.select(*head, "date", (F.col("amount") + more).alias("amount"), F.lit("USD").alias("currency"), "merchant_name", "description", F.lit(False).alias("pending"), "provider_category")

    feed = rows(txn, 1, "added").union(rows(txn.filter("tx_id % 50 = 0"), 1, "modified", 1)).union(rows(txn.filter("tx_id % 70 = 0"), 2, "removed")).to(spark.createDataFrame([], FEED).schema)
    known = accounts.filter("account_id % 11 != 0").select(F.col("account_id").cast("string").alias("provider_account_id"), "account_id", "user_id")
    ledger, _, _ = apply_feed(stored.union(waiting), feed, known)
    return ledger.select("provider_tx_id", "user_id", "amount", "is_removed", "category.value")


def text_model(batch: list[dict]) -> list[dict]:
    """stub_model for identifiers that are texts."""
    return [r | {"tx_id": b["tx_id"]} for r, b in zip(stub_model([{"tx_id": int(b["tx_id"])} for b in batch]), batch, strict=True)]


@query(
    "chain_streamed",
    tiers_sql("true") + edges_sql("true") + WALK + """,
late AS (SELECT tx_id FROM txn WHERE tx_id >= 1000000000000 AND tx_id % 10 = 7 AND user_id % 2 = 0),
modified AS (SELECT tx_id FROM txn WHERE tx_id % 30 = 0 AND user_id % 2 = 0),
verdict AS (SELECT tx_id, CASE WHEN tx_id % 20 > 0 THEN 'Dining' ELSE 'Uncategorized' END AS value,
  CASE WHEN tx_id % 20 = 0 OR tx_id // 10 % 5 = 0 OR CAST(tx_id // 10 % 100 AS DOUBLE) / 100 < CAST(0.7 AS DOUBLE) THEN 'needs_review' ELSE 'confirmed' END AS status FROM txn),
known AS (SELECT o.user_id, o.tx_id, o.merchant_norm, tier1, coalesce(tier2, fuzzy) AS tier2 FROM o LEFT JOIN t1 ON t1.user_id = o.user_id AND t1.merchant_norm = o.merchant_norm
  LEFT JOIN t2 ON t2.user_id = o.user_id AND t2.description = o.description LEFT JOIN fz ON fz.user_id = o.user_id AND fz.merchant_norm = o.merchant_norm),
taught AS (SELECT DISTINCT user_id, merchant_norm FROM known JOIN verdict USING (tx_id) WHERE tier1 IS NULL AND tier2 IS NULL AND status = 'confirmed' AND length(merchant_norm) > 0 AND tx_id NOT IN (FROM late)),
decided AS (SELECT k.user_id, k.tx_id, CASE WHEN tier1 IS NOT NULL OR by_rule THEN 1 WHEN tier2 IS NOT NULL THEN 2 ELSE 3 END AS tier, coalesce(tier1, CASE WHEN by_rule THEN 'Dining' END, tier2, v.value) AS value,
  CASE WHEN tier1 IS NOT NULL OR by_rule OR tier2 IS NOT NULL THEN 'confirmed' ELSE v.status END AS status
  FROM (SELECT *, tx_id IN (FROM late) AND (user_id, merchant_norm) IN (SELECT (user_id, merchant_norm) FROM taught) AS by_rule FROM known) k JOIN verdict v USING (tx_id)),
sides AS (SELECT anchor AS tx_id, anchor AS g FROM m UNION ALL SELECT other, anchor FROM m),
aging AS (SELECT d.*, v.value AS again, v.status AS again_status, g, amount, d.status = 'confirmed' AND NOT pending AND date <= DATE '2001-07-29' AND g IS NULL AND coalesce(starts_with(provider_category, 'TRANSFER_') OR provider_category = 'LOAN_PAYMENTS_CREDIT_CARD_PAYMENT', false) AS aged
  FROM decided d JOIN txn USING (tx_id) JOIN verdict v USING (tx_id) LEFT JOIN sides USING (tx_id))
-- A row that changes while it waits for a review is put to the model again.
SELECT lpad(CAST(tx_id AS VARCHAR), 20, '0') AS provider_tx_id, user_id, amount, tx_id % 70 = 0 AS is_removed, CASE WHEN aged AND tx_id IN (FROM modified) AND again_status <> 'confirmed' THEN 3 WHEN aged THEN 4 ELSE tier END AS tier,
  CASE WHEN aged AND tx_id IN (FROM modified) THEN again ELSE value END AS value, CASE WHEN aged THEN 'needs_review' ELSE status END AS status,
  'g-' || lpad(CAST(g AS VARCHAR), 20, '0') AS transfer_group_id, g IS NOT NULL AS excluded, CASE WHEN tx_id IN (FROM modified) THEN 'EUR' ELSE 'USD' END AS currency FROM aging""",
)
def _(spark, sf_dir, accounts):
    """The ledger after a stream of three pages: new rows of half of the users; those of the others, with changed and further rows of the first; removed rows.

    Every page is a run of its own from the stream's checkpoint, and the result is what one pass over all rows gives.
    """
    from .plans.store import cut, shared_place
    from .streaming.chain import Chain
    from .streaming.changefeed import FEED

    place = shared_place(spark, "chain")
    # Stored, as all pages and the corrected merchants are made from them.
    txn = adapter.transactions(spark, sf_dir, dealt=True).drop("merchant_override", "is_removed", "transfer_group_id", "exclude_from_cash_flow")
    txn.write.parquet(f"{place}/txn")
    txn = spark.read.schema(txn.schema).parquet(f"{place}/txn")
    tx = F.lpad(F.col("tx_id").cast("string"), 20, "0")

    def rows(of: DataFrame, page: int, op: str, currency: str = "USD") -> DataFrame:
        head = [F.lit(page).cast("long").alias("page"), F.lit(op).alias("op"), F.col("tx_id").alias("idx"), tx.alias("provider_tx_id"), F.lit(None).cast("string").alias("pending_tx_id"), F.col("account_id").cast("string").alias("provider_account_id")]
        return of.select(*head, "date", "amount", F.lit(currency).alias("currency"), "merchant_name", "description", "pending", "provider_category")

    even, late = "user_id % 2 = 0", "tx_id >= 1000000000000 and tx_id % 10 = 7"
    more = rows(txn.filter(f"not ({even}) or {late}"), 1, "added").union(rows(txn.filter(f"{even} and tx_id % 30 = 0"), 1, "modified", "EUR"))
    pages = [rows(txn.filter(f"{even} and not ({late})"), 0, "added"), more, rows(txn.filter("tx_id % 70 = 0"), 2, "removed")]
    known = accounts.select(F.col("account_id").cast("string").alias("provider_account_id"), "account_id", "user_id")
    # Every batch reads these; they are small beside the rows that they come from.
    rules, corrected = cut(adapter.rules(spark, sf_dir, dealt=True)), cut(C.first_corrected(C.corrected_merchants(txn)))
    chain = Chain(spark, f"{place}/tables", text_model, ["Dining", "Uncategorized"], AS_OF, user_buckets=2, slots=8)
    for page in pages:
        page.write.mode("append").parquet(f"{place}/feed")
        run = chain.start(spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1_000_000).parquet(f"{place}/feed"), known, rules, corrected)
        run.awaitTermination()
    out = chain.ledger.read_all()
    return out.select("provider_tx_id", "user_id", "amount", "is_removed", "category.tier", "category.value", "category.status", "transfer_group_id", F.col("exclude_from_cash_flow").alias("excluded"), "currency")
