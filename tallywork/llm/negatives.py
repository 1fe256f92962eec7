"""Hard-negative mining by a two-dimensional block matrix multiply.

Scores are integer inner products of quantised vectors, each component floor(256 * x). Anchors and rows are dealt to blocks,
dimensions to chunks; the panels of each block and chunk are stored. Panel (I, k) of the anchors is copied to every column of
the grid, panel (J, k) of the rows to every line, and shuffled to their place (I, J). There the products of the chunks are
partial scores, added as 64-bit integers. Scores are made twice and never leave their place: first the best rows of the
anchor's own label are reduced to its positives; these give each (anchor, positive) a window of scores, and then each place's
best rows of other labels in that window are reduced to the negatives. A place has a bounded number of anchors and of
components, whatever the input's size, and scores SLICE anchors at a time; per anchor and place only a top-k leaves it.

Higher scores come first, ties by smaller vec_id, then by the rows' stored number, so rows that repeat count each for
itself; an anchor is never its own positive, another row of its vec_id may be. Rows with a null label, vector or component,
one that is not finite, or without a vec_id, which could not be named in the result, take no part. Vectors of different
lengths are filled up with zeros. Scores are exact where they fit into 64 bits; components beyond 64 bits are held at the
limit. Without anchors, positives or rows in a window there are no rows in the result. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, parts, read_table, run_dir

POSITIVES, NEGATIVES = 5, 10
#: A negative's score in percent of the positive's, at least and at most.
LOW, HIGH = 30, 90
#: Anchors and rows of a place of the grid at most, components of its rows at most, dimensions of a chunk.
ANCHORS, ROWS, CELLS, DIMS = 1024, 16384, 1 << 20, 32
#: Anchors of a place that are scored at a time.
SLICE = 64
SCALE = 256
PANEL = "block long, k long, panel binary, kind string, ids binary, labels binary, numbers binary"
HEADS = ("ids", "labels", "numbers")


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def quantised(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        x = np.floor(np.asarray(v, np.float64) * SCALE)
        held = np.clip(x, -(2.0**63), np.nextafter(2.0**63, 0))
        out[i, : len(x)] = held.astype(np.int64)
    return out


def smallest_kind(x: np.ndarray) -> str:
    most = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    return "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"


def grid(n_anchors: int, n: int, width: int, tasks: int) -> tuple[int, int]:
    """Lines and columns: blocks of bounded size, smaller ones (of 2048 rows or more) as long as there are fewer places than tasks."""
    lines = max(1, -(-n_anchors // ANCHORS))
    most = max(1, min(ROWS, CELLS // max(1, width)))
    return lines, max(1, -(-n // most), min(-(-n // 2048), -(-tasks // lines)))


def panels(rows: DataFrame, n_blocks: int, n_chunks: int) -> DataFrame:
    """The rows (number, vec_id, label, vector) as PANEL: a row for each block and chunk of dimensions; the first chunk's names its rows, by vec_id."""
    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "number"])
        values = quantised(pdf["vector"], n_chunks * DIMS)
        heads = [pdf[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "label", "number")]
        out = []
        for k in range(n_chunks):
            x = values[:, k * DIMS : (k + 1) * DIMS]
            kind = smallest_kind(x)
            out.append((pdf["block"].iloc[0], k, np.ascontiguousarray(x, kind).tobytes(), kind, *(heads if k == 0 else (None,) * 3)))
        return pd.DataFrame(out, columns=["block", "k", "panel", "kind", *HEADS])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(n_blocks)))
    return dealt.groupBy("block").applyInPandas(packed, PANEL)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times the transpose of b in 64-bit integers; by floating point where that is exact."""
    most = [max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0 for x in (a, b)]
    if most[0] * most[1] * a.shape[1] < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most[0] * most[1] * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def copies(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


class Tile:
    """The place of a block of anchors and a block of rows (by vec_id and number) in the grid: their names, and scores slice by slice."""

    def __init__(self, a: pd.DataFrame, b: pd.DataFrame):
        a, b = a.sort_values("k"), b.sort_values("k")
        (self.a_ids, self.a_labels, self.a_numbers), (self.ids, self.labels, self.numbers) = ([np.frombuffer(x[c].iloc[0], "<i8") for c in HEADS] for x in (a, b))
        self.a, self.b = ([np.frombuffer(p, kind).reshape(len(x["ids"].iloc[0]) // 8, -1) for p, kind in zip(x["panel"], x["kind"], strict=True)] for x in (a, b))

    def lines(self, wanted=None):
        """Number in the block and scores of each anchor (of those wanted); SLICE anchors are scored at a time, chunk by chunk, and the chunks' partial scores added."""
        at = np.arange(len(self.a_ids)) if wanted is None else np.asarray(sorted(wanted), np.int64)
        for some in (at[i : i + SLICE] for i in range(0, len(at), SLICE)):
            total = product(self.a[0][some], self.b[0])
            for x, y in zip(self.a[1:], self.b[1:], strict=True):
                total += product(x[some], y)
            yield from zip(some.tolist(), total, strict=True)


def first(scores: np.ndarray, at: np.ndarray, top: int) -> np.ndarray:
    """Of the columns at, the top by falling score; ties stay in their order."""
    if len(at) > top:
        some = scores[at]
        at = at[some >= np.partition(some, len(at) - top)[len(at) - top]]
    return at[np.argsort(-scores[at], kind="stable")][:top]


def positives(anchors: DataFrame, rows: DataFrame, n_lines: int, n_columns: int, top: int = POSITIVES) -> DataFrame:
    """line, number, positive_id, positive, positive_score: each anchor's top other rows of its label."""
    columns = ["line", "number", "positive_id", "positive", "positive_score"]

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(b):
            t = Tile(a, b)
            of = {la: np.flatnonzero(t.labels == la) for la in np.unique(t.a_labels)}
            for i, scores in t.lines():
                at = of[t.a_labels[i]]
                at = first(scores, at[t.numbers[at] != t.a_numbers[i]], top)
                out += zip([key[0]] * len(at), [t.a_numbers[i]] * len(at), t.ids[at], t.numbers[at], scores[at], strict=True)
        return pd.DataFrame(out, columns=columns)

    found = met(anchors, rows, n_lines, n_columns).applyInPandas(run, ", ".join(f"{c} long" for c in columns))
    order = Window.partitionBy("number").orderBy(F.desc("positive_score"), "positive_id", "positive")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).drop("r")


def negatives(anchors: DataFrame, rows: DataFrame, n_lines: int, n_columns: int, chosen: DataFrame, top: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score and the numbers: the top rows of other labels in each pair's window."""
    # At most ANCHORS times the positives of one anchor.
    windows = chosen.groupBy("line").agg(F.collect_list(F.struct("number", "positive_id", "positive", "positive_score")).alias("pairs"))
    columns = ["anchor", "anchor_id", "positive", "positive_id", "positive_score", "negative", "negative_id", "negative_score"]
    # With the first chunk go the windows, as its names do.
    anchors = anchors.join(windows.withColumnRenamed("line", "block"), "block").withColumn("pairs", F.when(F.col("k") == 0, F.col("pairs")))

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(b):
            t = Tile(a, b)
            place = {int(n): i for i, n in enumerate(t.a_numbers)}
            by: dict[int, list] = {}
            for p in a["pairs"][a["k"] == 0].iloc[0]:
                by.setdefault(place[int(p["number"])], []).append(p)
            of = {la: np.flatnonzero(t.labels != la) for la in np.unique(t.a_labels)}
            for i, scores in t.lines(by):
                others = of[t.a_labels[i]]
                other = scores[others]
                for p in by[i]:
                    score = int(p["positive_score"])
                    # low * score <= 100 * negative <= high * score, in integers.
                    at = first(scores, others[(other >= -(-low * score // 100)) & (other <= high * score // 100)], top)
                    n = len(at)
                    out += zip([t.a_numbers[i]] * n, [t.a_ids[i]] * n, [p["positive"]] * n, [p["positive_id"]] * n, [score] * n, t.numbers[at], t.ids[at], scores[at], strict=True)
        return pd.DataFrame(out, columns=columns)

    found = met(anchors, rows, n_lines, n_columns).applyInPandas(run, ", ".join(f"{c} long" for c in columns))
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("negative_score"), "negative_id", "negative")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def met(anchors: DataFrame, rows: DataFrame, n_lines: int, n_columns: int):
    """The panels of every place of the grid, all chunks of its line's anchors and of its column's rows."""
    a = anchors.select(F.col("block").alias("line"), copies(n_columns).alias("col"), *[c for c in anchors.columns if c != "block"])
    b = rows.select(copies(n_lines).alias("line"), F.col("block").alias("col"), *[c for c in rows.columns if c != "block"])
    return a.groupBy("line", "col").cogroup(b.groupBy("line", "col"))


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives among rows (vec_id, label, embedding) for each anchor and positive."""
    spark = rows.sparkSession
    place = run_dir(spark, "negatives")
    used = rows.filter(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    used = used.select(F.monotonically_increasing_id().alias("number"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    used = materialize(used, f"{place}/rows")
    n, n_anchors, width = used.agg(F.count("*"), F.count(F.when(is_anchor, 1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    chunks = max(1, -(-width // DIMS))
    lines, columns = grid(n_anchors, n, chunks * DIMS, parts(spark))
    a, b = (materialize(panels(some, m, chunks), f"{place}/{name}") for some, m, name in ((used.filter(is_anchor), lines, "anchors"), (used, columns, "panels")))
    chosen = materialize(positives(a, b, lines, columns, n_positives), f"{place}/positives")
    return negatives(a, b, lines, columns, chosen, n_negatives, low, high)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


OP13_SQL = """
WITH usable AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.positive_id, s.other_id AS negative_id, p.positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM pos p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score) WHERE rank <= 10
"""
