"""Mixing sources to target weights by a time-varying curriculum.

Each source's weight over training time t in [0, 1] is a line whose integral is the source's target in words:
w(t) = target * (1 + slope * (2t - 1)). Demand up to t is the integral D(t) = target * (t + slope * (t^2 - t)). A copy
of a document that starts at word c of its source's stream is due at the t with D(t) = c; documents are then sorted by
that position over the whole mix.

Sizes count words; a null text has size 0. A null source is a source of its own, last by code point. Targets share
`budget` (default: all words) by weight, stop at `cap` times the source's size, and the excess goes to the others by
weight until none is above. A source takes whole passes over its documents (at most `cap`) and then documents in a
fixed hashed order until its target is met; the last one is cut. A source without words takes nothing. Rows with the
same doc_id are taken each on its own, in an order that their sizes and then their row numbers settle. An empty table gives
no rows; further columns of docs are kept by mix_documents(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NOT_WS, materialize, numbered, prefix_sums, read_table, run_dir

#: Weights by rank of the source, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Slope of a source's weight over time, by the same rank: early, even, late.
SLOPES = (-0.5, 0.0, 0.5)


def sized(docs: DataFrame) -> DataFrame:
    """row (a number of each row, which stays once this is written), doc_id, source and size (words) of each document."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(NOT_WS)).cast("long")
    row = F.col("__row") if "__row" in docs.columns else F.monotonically_increasing_id()
    return docs.select(row.alias("row"), "doc_id", "source", words.alias("size"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, cap: float = 3.0) -> DataFrame:
    """One row per source: source, source_size, target, slope. Its windows run over sources, not documents."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")))
    per = per.withColumn("slope", F.element_at(F.array(*map(F.lit, slopes)), (rank + 1).cast("int")))
    per = per.withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    # Fill to one level: sources in order of cap / weight stop at their cap as long as the level of the others exceeds it.
    whole = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", rest / open_weight)
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"])
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("level")))
    return per.select("source", "source_size", target.alias("target"), "slope")


def take(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """sizes with source_size, target, slope, before (words ahead of the document in its source's stream) and taken."""
    streamed = prefix_sums(sizes, "source", "doc_id", "size", "before", "row")
    t = targets.select(F.col("source").alias("__s"), "source_size", "target", "slope")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    left = F.floor(F.col("target")) - full * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("before")))
    return streamed.join(t, F.col("source").eqNullSafe(F.col("__s"))).drop("__s").withColumn("taken", (full * F.col("size") + part).cast("long"))


def position(words_before, target, slope):
    """Training time in [0, 1] at which a source's cumulative demand reaches words_before."""
    q = F.least(F.lit(1.0), words_before / target)
    root = F.sqrt(F.greatest(F.lit(0.0), (1 - slope) * (1 - slope) + 4 * slope * q))
    return F.when(target > 0, F.when(slope == 0, q).otherwise((root - (1 - slope)) / (2 * slope))).otherwise(F.lit(0.0))


def curriculum(taken: DataFrame) -> DataFrame:
    """One row per copy that the mix takes: row, doc_id, source, pass_no, words, position; range-sorted by position."""
    copies = F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)
    rows = taken.filter("taken > 0").withColumn("pass_no", F.explode(copies))
    words = F.least(F.col("size"), F.col("taken") - F.col("pass_no") * F.col("size"))
    at = position(F.col("pass_no") * F.col("source_size") + F.col("before"), F.col("target"), F.col("slope"))
    rows = rows.select("row", "doc_id", "source", "pass_no", words.alias("words"), at.alias("position"))
    by = ("position", "source", "doc_id", "pass_no", "row")
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def plan(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, cap: float = 3.0) -> DataFrame:
    """What the mix takes of each document, with the position of its first copy."""
    sizes = materialize(sized(docs), run_dir(docs.sparkSession, "mix"))
    taken = take(sizes, source_targets(sizes, weights, slopes, cap))
    first = F.when(F.col("taken") > 0, position(F.col("before"), F.col("target"), F.col("slope")))
    return taken.withColumn("first_position", first)


def mix_documents(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, cap: float = 3.0) -> DataFrame:
    """The mixed corpus with docs' columns: a row for each copy, texts cut where the last copy is cut, sorted by position.

    Rows are numbered first, and copies are joined to texts by that number; documents of which nothing is taken go.
    """
    rows = numbered(docs, "mixed")
    copies = curriculum(plan(rows, weights, slopes, cap)).select(F.col("row").alias("__r"), "words", "position", "pass_no")
    copies = copies.withColumnsRenamed({"words": "__words", "position": "__position", "pass_no": "__pass"})
    rows = rows.join(copies, F.col("__row") == F.col("__r"))
    have = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(NOT_WS))
    # Words with the white space behind each; what is ahead of the first counts as one more.
    pieces = F.split(F.col("text"), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    ahead = F.col("text").rlike(r"^[\x20\x09-\x0D]").cast("int")
    cut = F.array_join(F.slice(pieces, F.lit(1), (F.col("__words") + ahead).cast("int")), "")
    rows = rows.withColumn("text", F.when(have > F.col("__words"), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    by = ("__position", "doc_id", "__pass", "__row")
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return rows.select(*docs.columns)


def scheduled(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, cap: float = 3.0) -> DataFrame:
    """Each document with what the schedule's copies hold of it: taken (words), passes, first_position, last_position. The schedule is written whole, in its order."""
    place = run_dir(docs.sparkSession, "schedule")
    planned = materialize(plan(docs, weights, slopes, cap).drop("first_position"), f"{place}/plan")
    copies = materialize(curriculum(planned), f"{place}/copies")
    per = copies.groupBy("row").agg(F.sum("words").alias("taken"), F.min("position").alias("first_position"), F.max("position").alias("last_position"), F.count("*").alias("passes"))
    out = planned.drop("taken").join(per, "row", "left")
    return out.withColumns({"taken": F.coalesce("taken", F.lit(0).cast("long")), "passes": F.coalesce("passes", F.lit(0).cast("long"))})


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scheduled(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "passes", "first_position", "last_position")


OP5_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS most FROM per),
levels AS (SELECT most / w AS ratio, (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM weighed WINDOW b AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE level <= ratio),
targets AS (SELECT source, source_size, coalesce(least(most, w * (SELECT level FROM lev)), most) AS target, CAST(CASE w WHEN 5 THEN -0.5 WHEN 2 THEN 0 ELSE 0.5 END AS DOUBLE) AS slope FROM weighed),
streamed AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
mixed AS (SELECT *, CAST(whole * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - whole * source_size - before)) AS BIGINT) AS taken FROM streamed),
passed AS (SELECT *, CASE WHEN taken > 0 THEN CAST((taken + size - 1) // size AS BIGINT) ELSE 0 END AS passes FROM mixed),
demand AS (SELECT *, least(1.0::DOUBLE, before / target) AS q1, least(1.0::DOUBLE, ((passes - 1) * source_size + before) / target) AS q2 FROM passed)
SELECT doc_id, size, source_size, target, taken, passes,
  CASE WHEN taken = 0 THEN NULL WHEN slope = 0 THEN q1 ELSE (sqrt(greatest(0, (1 - slope) * (1 - slope) + 4 * slope * q1)) - (1 - slope)) / (2 * slope) END AS first_position,
  CASE WHEN taken = 0 THEN NULL WHEN slope = 0 THEN q2 ELSE (sqrt(greatest(0, (1 - slope) * (1 - slope) + 4 * slope * q2)) - (1 - slope)) / (2 * slope) END AS last_position
FROM demand
"""
