"""Scalar functions of the ledger as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories that mark a transfer, the placeholder category, labels and thresholds.
TRANSFER_PREFIX = "TRANSFER_"
TRANSFER_PAYMENT = "LOAN_PAYMENTS_CREDIT_CARD_PAYMENT"
UNCATEGORIZED = (4, "Uncategorized", "needs_review")
LIABILITIES = ("credit", "loan")
PALETTE_SIZE = 8
CONFIDENCE = 0.7
#: Provider codes after which the user must log in again, after which an item must be linked anew, and of a cursor that is of no use.
REAUTH_CODES = ("ITEM_LOGIN_REQUIRED", "ITEM_LOCKED")
REVOKED_CODES = ("USER_PERMISSION_REVOKED", "USER_ACCOUNT_REVOKED", "ITEM_NOT_FOUND", "ACCESS_NOT_GRANTED")
CURSOR_CODES = ("TRANSACTIONS_SYNC_INVALID_CURSOR", "INVALID_CURSOR", "TRANSACTIONS_SYNC_CURSOR_NOT_FOUND")


def merchant_key(name: Column, description: Column) -> Column:
    """name, or description where name is blank; lower case, runs of other than a-z and 0-9 as one space, trimmed."""
    used = F.when(F.length(F.trim(F.coalesce(name, F.lit("")))) > 0, name).otherwise(F.coalesce(description, F.lit("")))
    return F.trim(F.regexp_replace(F.lower(used), "[^a-z0-9]+", " "))


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def month_end(d: Column) -> Column:
    return F.last_day(d)


def week_start(d: Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", d).cast("date")


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def to_cents(x: Column) -> Column:
    """Halves go up, also below zero; null is 0."""
    return F.floor(F.coalesce(x, F.lit(0.0)) * 100 + 0.5).cast("long")


def dollars(cents: Column, sign: str = "plain") -> Column:
    """$1,234 without decimals. sign: plain; flipped (the ledger counts spending as positive); explicit (+ or - ahead)."""
    c = -cents if sign != "plain" else cents
    units = F.floor(F.abs(c) / 100 + 0.5)
    body = F.concat(F.lit("$"), F.format_number(units, 0))
    # A sign stays where the amount rounds to 0.
    ahead = F.when(c < 0, F.lit("-")).when(F.lit(sign == "explicit") & (c > 0), F.lit("+")).otherwise(F.lit(""))
    return F.concat(ahead, body)


def account_type(t: Column) -> Column:
    return F.when(t == "brokerage", "investment").when(t.isin("depository", "credit", "loan", "investment"), t).otherwise("depository")


def currency(iso: Column, unofficial: Column) -> Column:
    return F.coalesce(iso, unofficial, F.lit("USD"))


def is_transfer_signal(category: Column) -> Column:
    return F.coalesce(category.startswith(TRANSFER_PREFIX) | (category == TRANSFER_PAYMENT), F.lit(False))


def is_uncategorized(category: Column) -> Column:
    tier, value, status = UNCATEGORIZED
    return F.coalesce((category["tier"] == tier) & (category["value"] == value) & (category["status"] == status), F.lit(False))


def is_liability(t: Column) -> Column:
    return t.isin(*LIABILITIES)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / most)


def similar(a: Column, b: Column) -> Column:
    """similarity at least 0.8, in integers; empty texts are never similar."""
    most = F.greatest(F.length(a), F.length(b))
    return (F.length(a) > 0) & (F.length(b) > 0) & (5 * F.levenshtein(a, b) <= most)


def model_outcome(uncertain: Column, confidence: Column, threshold: float = CONFIDENCE) -> Column:
    return F.when(uncertain | (confidence < threshold), "needs_review").otherwise("confirmed")


def json_payload(content: Column) -> Column:
    """The text of a fenced block, else from the first [ to the last ], else the whole, trimmed."""
    fenced = F.regexp_extract(content, r"(?s)```(?:json)?\s*(.*?)```", 1)
    outer = F.regexp_extract(content, r"(?s)(\[.*\])", 1)
    found = F.when(content.rlike(r"(?s)```(?:json)?\s*.*?```"), fenced).when(outer != "", outer).otherwise(content)
    return F.regexp_replace(found, r"^\s+|\s+$", "")


def webhook_kind(body: Column) -> Column:
    """sync, item_error:reauth_required, item_error:revoked or ignored, of a webhook's JSON text. An error's own code goes before the webhook's."""
    field = lambda path: F.nullif(F.get_json_object(body, path), F.lit(""))
    kind, code = field("$.webhook_type"), field("$.webhook_code")
    what = F.coalesce(field("$.error.error_code"), code)
    item = field("$.item_id").isNotNull()
    return (
        F.when(item & (kind == "TRANSACTIONS") & (code == "SYNC_UPDATES_AVAILABLE"), "sync")
        .when(item & (kind == "ITEM") & what.isin(*REAUTH_CODES, "PENDING_EXPIRATION"), "item_error:reauth_required")
        .when(item & (kind == "ITEM") & what.isin(*REVOKED_CODES), "item_error:revoked")
        .otherwise("ignored")
    )


def error_kind(status: Column, code: Column, error_type: Column | None = None) -> Column:
    """Rate limits come first, changes during paging before bad cursors; null: an error that nothing treats specially."""
    limited = F.coalesce(status == 429, F.lit(False)) | F.coalesce(code == "RATE_LIMIT_EXCEEDED", F.lit(False))
    if error_type is not None:
        limited |= F.coalesce(error_type == "RATE_LIMIT_EXCEEDED", F.lit(False))
    return (
        F.when(limited, "rate_limit")
        .when(code.isin(*REAUTH_CODES), "reauth_required")
        .when(code.isin(*REVOKED_CODES, "ITEM_NOT_SUPPORTED"), "revoked")
        .when(code == "TRANSACTIONS_SYNC_MUTATION_DURING_PAGINATION", "mutation_during_pagination")
        .when(code.isin(*CURSOR_CODES), "invalid_cursor")
    )


def terminal_status(kind: Column) -> Column:
    """The status that an error leaves a connection in until its user acts; null: it may be tried again."""
    return F.when(kind == "reauth_required", "login_required").when(kind == "revoked", "error")


def retry_after_ms(seconds: Column) -> Column:
    value = seconds.try_cast("double")
    return F.when(value >= 0, value * 1000).cast("long")


def days_requested(x: Column) -> Column:
    """Rounded and held within 30 to 90; null is 30."""
    return F.coalesce(F.least(F.greatest(F.floor(x + 0.5), F.lit(30)), F.lit(90)), F.lit(30)).cast("int")


def category_kind(kind: Column) -> Column:
    return F.coalesce(kind, F.lit("expense"))


def palette_index(n: Column) -> Column:
    return n % PALETTE_SIZE


def display_merchant(override: Column, name: Column, normalized: Column) -> Column:
    return F.coalesce(override, name, normalized)


def display_account(nickname: Column, official: Column, institution: Column) -> Column:
    return F.coalesce(nickname, official, institution)


def day_label(d: Column) -> Column:
    return F.date_format(d, "MMM d")


def month_label(d: Column) -> Column:
    return F.date_format(d, "MMM yy")


def synced_ago(at: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 60)
    when = (
        F.when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes, F.lit("m ago"))).when(minutes < 1440, F.concat(F.floor(minutes / 60), F.lit("h ago"))).otherwise(F.date_format(at, "MMM d, h:mm a"))
    )
    return F.when(at.isNull(), "Never synced yet").otherwise(F.concat(F.lit("Synced "), when))


def frequency(gap: Column, monthly: float = 30, monthly_tol: float = 5, annual: float = 365, annual_tol: float = 20) -> Column:
    """monthly is tried before annual; null: neither."""
    return F.when(F.abs(gap - monthly) <= monthly_tol, "monthly").when(F.abs(gap - annual) <= annual_tol, "annual")
