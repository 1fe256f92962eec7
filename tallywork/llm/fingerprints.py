"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions alone.

A text's shingles are its runs of `width` lower-cased words (with fewer words: all of them as one; without words: none).
Its sketch holds the k smallest distinct 64-bit hashes, ascending. Sketches of parts merge into the sketch of the whole.
Two sketches estimate resemblance (Jaccard) and containment; one estimates the number of distinct shingles. Two empty
sketches resemble each other fully. Null texts count as empty; a text of any length is worked on whole. Rows that share a
doc_id follow one another in order of their text's hash, rows without one come first, and a table of one row follows itself.
An empty table gives no rows; the query reads no further columns.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WS, parts, read_table

K = 128
WIDTH = 5
SPACES = " \t\n\x0b\x0c\r"


def bound(value: Column, body) -> Column:
    """body(value) with value worked out once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    trimmed = F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACES))

    def smallest(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(1)))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, width)))
        return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)

    none = F.array().cast("array<bigint>")
    return bound(trimmed, lambda t: F.when(t == "", none).otherwise(bound(F.split(t, WS), smallest)))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's k smallest hashes that both sketches hold."""
    both = bound(merge(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k; beyond, (k - 1) over the share of the hash range that the k-th smallest hash has reached."""
    reached = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reached)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    share = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def merge_parts(sketches: DataFrame, key: str, column: str, k: int = K) -> DataFrame:
    """One sketch for each key of the sketches of its parts.

    Hashes are made distinct before they meet, and each task keeps its k smallest of a key before the final ranking.
    """
    hashes = sketches.select(F.col(key), F.explode_outer(column).alias("h")).distinct()
    first = hashes.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("h").asc_nulls_last()))).filter(F.col("r") <= k)
    return first.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(column))


def as_text(a: Column) -> Column:
    """16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def order_buckets(docs: DataFrame, spread: int = 8):
    """A Column that deals (doc_id, h) into contiguous ranges of about equal counts; rows without a doc_id come first.

    The bounds are approximate quantiles of doc_id over the whole column, in two levels so that a row is compared with few
    of them. A doc_id that is several quantiles at once, or the lack of one, is cut further, evenly by the text's hash h.
    """
    side = math.ceil(math.sqrt(spread * max(1, parts(docs.sparkSession))))
    n = side * side
    got = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 4 * n).alias("q"), F.count("*").alias("rows"), F.count("doc_id").alias("known")).first()
    times = Counter(got["q"] or [])
    cuts = sorted(times)
    # Pieces of a doc_id: as many as it is quantiles, but no more than it has rows, about.
    pieces = {v: min(m, m * got["known"] // n) for v, m in times.items()}
    pieces = {v: m for v, m in pieces.items() if m > 1}
    unknown = max(1, n * (got["rows"] - got["known"]) // max(1, got["rows"]))
    coarse = [cuts[i] for i in range(side - 1, len(cuts), side)]
    fine = [cuts[i : i + side - 1] for i in range(0, len(cuts), side)] or [[]]
    fine += [[]] * (len(coarse) + 1 - len(fine))
    longs = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda b: b < F.col("doc_id")))
    at = bound(below(longs(coarse)), lambda c: c * side + below(F.element_at(F.array(*map(longs, fine)), c + 1))) + 1
    # The share of all hashes that lie below h, in m pieces: it grows with h.
    cut = lambda m: F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * m), m - 1)
    width = max([unknown, *(m + 1 for m in pieces.values())])
    inside = F.lit(0).cast("long")
    if pieces:
        m = F.element_at(F.create_map(*(F.lit(x) for v in pieces.items() for x in v)), F.col("doc_id"))
        inside = F.coalesce(cut(m) + 1, inside)
    place = F.when(F.col("doc_id").isNull(), cut(F.lit(unknown))).otherwise(at * width + inside)
    return place.cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, fp) with the text and fp of the next document by doc_id (after the last: the first).

    Rows are dealt by contiguous ranges of doc_id and the hash of the text, and the first row of each range is copied to the
    range before it as a guard, so that no window spans all rows, or all of a doc_id.
    """
    at = docs.withColumn("h", F.xxhash64("text")).withColumn("bucket", order_buckets(docs))
    firsts = at.groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("f"))
    # One row for each range: their number is fixed by the shuffle partitions, not by the rows.
    order = Window.orderBy("bucket")
    firsts = firsts.withColumn("before", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())))
    firsts = firsts.select(F.col("f.doc_id").alias("__d"), F.col("f.h").alias("__h"), "before")
    marked = at.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("h") == F.col("__h")), "left")
    places = F.when(F.col("before").isNull(), F.array(F.struct(F.lit(0).alias("guard"), F.col("bucket").alias("place")))).otherwise(
        F.array(F.struct(F.lit(0).alias("guard"), F.col("bucket").alias("place")), F.struct(F.lit(1).alias("guard"), F.col("before").alias("place")))
    )
    dealt = marked.select("doc_id", "text", "h", "fp", F.inline(places))
    w = Window.partitionBy("place").orderBy("guard", "doc_id", "h")
    rows = dealt.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fp", F.lead("fp").over(w))
    return rows.filter("guard = 0").drop("guard", "place", "h")


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n / 4) code points replaced by the first as many of the following text."""
    n = F.char_length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("fp", sketch(F.col("text"))))
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_fp", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        resemblance(F.col("fp"), F.col("next_fp")).alias("near_next"),
        distinct_shingles(F.col("fp")).alias("distinct_shingles"),
    )
