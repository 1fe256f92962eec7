"""Connected components of a graph whose links are rows, by alternating stars.

In a large star each node hands its larger neighbours to the smallest node of its neighbourhood; in a small star each
node hands its smaller neighbours, and itself, to the smallest of them. Both keep components whole; when every node hangs
on one node that hangs on none, that is the smallest node of its component. Neighbourhoods are never gathered: their
smallest node is an aggregate that is joined back, so a node with very many links costs no more memory than another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, place: str, most_rounds: int = 60) -> DataFrame:
    """node and root (smallest node of its component) for every node that links (columns a, b) name."""
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    e = materialize(e, f"{place}/links-0")
    for i in range(1, most_rounds + 1):
        if _settled(e):
            break
        e = materialize(_small_star(_large_star(e)), f"{place}/links-{i}")
    else:
        raise RuntimeError("the components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _settled(e: DataFrame) -> bool:
    """Whether every node hangs on one node that hangs on none."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").isEmpty()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    rows = both.filter("v > u").join(least.hint("merge"), F.col("u") == F.col("w"))
    return rows.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")


def _small_star(e: DataFrame) -> DataFrame:
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    rows = e.join(least.withColumnRenamed("u", "w").hint("merge"), F.col("u") == F.col("w"))
    handed = rows.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
