"""Merkle manifest of a dataset, with parent-preimage paths.

A row's leaf is the SHA-256 of its five fields, each `-` if null, else its UTF-8 byte count, `:` and its value. Leaves of a
source stand in order of doc_id (null first; rows of one doc_id by their leaf); every three neighbours, the last run
perhaps fewer, make a parent until one node is left, the source's subroot. Subroots in order of source (null first, by
bytes) make the root in the same way. Digests are hashed as lowercase hex text.

Every parent's preimage, its children's digests one behind the other, is stored. A leaf joins the preimages of its
ancestors: cutting its own 64 characters out of each leaves the siblings, and putting another digest there instead and
hashing again, level by level, gives the root that a changed row would have.

Six levels are built at a time: 729 neighbours form a block, whose own top is a node of the next round, so N leaves take
log(N) / log(729) rounds of thin rows, and no group is larger than a block, however large its source is. Paths are handed
down from block to block in the other direction. Texts are hashed where they are read and never shuffled.

Empty texts have length 0; very long ones are hashed whole; rows that repeat are leaves of their own; a row without a doc_id
counts as unchanged in the query. An empty table has no leaves and no root. Only the five columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, run_dir

#: Children of a parent, levels of a block, characters of a digest.
FAN, DEPTH, HEX = 3, 6, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def tree_of(source: Column) -> Column:
    """A name of a source that is never null and sorts as the sources do, null first."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), source))


def height(n: Column) -> Column:
    """Levels above n leaves: the least h with FAN ** h >= n."""
    powers = F.array(*(F.lit(FAN**i) for i in range(39)))
    return F.size(F.filter(powers, lambda p: p < n))


def ranked(rows: DataFrame, order: list[str], place: str) -> DataFrame:
    """rows with idx, their place in their tree by order from 0, and levels, the height of that tree.

    Ranges are sorted and numbered where they lie; for each tree only the counts of its ranges are summed along it.
    """
    at = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    at = materialize(at.withColumns({"__n": F.monotonically_increasing_id(), "__part": F.spark_partition_id()}), place)
    runs = at.groupBy("tree", "__part").agg(F.min("__n").alias("__start"), F.count("*").alias("__size"))
    along = Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__size").over(along), F.lit(0))
    runs = runs.select("tree", "__part", "__start", before.alias("__before"), height(F.sum("__size").over(Window.partitionBy("tree"))).alias("levels"))
    out = at.join(runs, ["tree", "__part"]).withColumn("idx", F.col("__n") - F.col("__start") + F.col("__before"))
    return out.drop("__n", "__part", "__start", "__before")


def blocks(nodes: DataFrame) -> DataFrame:
    """One row for each block of neighbours: tree, block, levels, kids (idx, hash, carry), their parents' preimages pre1 to pre6, and top.

    Levels beyond the tree's height have no preimages.
    """
    size = FAN**DEPTH
    out = nodes.groupBy("tree", "levels", F.floor(F.col("idx") / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "hash", "carry"))).alias("kids"))
    out = out.withColumn("hashes", F.col("kids.hash"))
    for j in range(1, DEPTH + 1):
        runs = F.sequence(F.lit(0), F.floor((F.size("hashes") - 1) / FAN).cast("int"))
        joined = F.transform(runs, lambda i: F.array_join(F.slice("hashes", i * FAN + 1, F.lit(FAN)), ""))
        out = out.withColumn(f"pre{j}", F.when(F.col("levels") >= j, joined))
        out = out.withColumn("hashes", F.when(F.col("levels") >= j, F.transform(f"pre{j}", lambda x: F.sha2(x, 256))).otherwise(F.col("hashes")))
    return out.withColumn("top", F.element_at("hashes", 1)).drop("hashes")


def build(nodes: DataFrame, place: str) -> tuple[list[DataFrame], DataFrame]:
    """(the stored blocks of each round, tree and its root) of nodes (tree, levels, idx, hash, carry)."""
    rounds = []
    while True:
        rounds.append(materialize(blocks(nodes), f"{place}/round-{len(rounds)}"))
        open_ = rounds[-1].filter(F.col("levels") > DEPTH)
        if open_.isEmpty():
            break
        nodes = open_.select("tree", (F.col("levels") - DEPTH).alias("levels"), F.col("block").alias("idx"), F.col("top").alias("hash"), F.lit(None).cast("string").alias("carry"))
    done = [t.filter(F.col("levels") <= DEPTH).select("tree", F.col("top").alias("hash")) for t in rounds]
    return rounds, reduce(DataFrame.unionByName, done)


def ancestors(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """carry, hash, path (preimage and own slot in it, from the parent up to the root) and the columns of above of each node.

    above: what every tree's nodes share, by tree: a path from the tree's root on upwards, and further columns.
    """
    shared = [c for c in above.columns if c not in ("tree", "path")]
    down = None
    for t in reversed(rounds):
        top = t.filter(F.col("levels") <= DEPTH).select("tree", "block").join(above, "tree")
        down = top if down is None else top.unionByName(down)
        at = t.join(down, ["tree", "block"]).withColumn("kid", F.explode("kids"))
        idx = F.col("kid.idx")
        steps = [
            F.struct(F.get(F.col(f"pre{j}"), F.floor((idx % FAN**DEPTH) / FAN**j).cast("int")).alias("preimage"), (F.floor(idx / FAN ** (j - 1)) % FAN).cast("int").alias("slot"))
            for j in range(1, DEPTH + 1)
        ]
        own = F.filter(F.array(*steps), lambda s: s["preimage"].isNotNull())
        down = at.select("tree", idx.alias("block"), F.col("kid.hash").alias("hash"), F.col("kid.carry").alias("carry"), F.concat(own, F.col("path")).alias("path"), *shared)
        if t is not rounds[0]:
            down = down.drop("hash", "carry")
    return down.drop("tree", "block")


def siblings(path: Column) -> Column:
    """Digests of the others of each run on the path, one behind the other."""
    cut = lambda s: F.concat(F.substring(s["preimage"], F.lit(1), s["slot"] * HEX), F.substring(s["preimage"], s["slot"] * HEX + HEX + 1, F.lit(FAN * HEX)))
    return F.array_join(F.transform(path, cut), "")


def folded(hash_: Column, path: Column) -> Column:
    """The root that follows when hash_ takes its place at the foot of the path."""
    def step(now: Column, s: Column) -> Column:
        return F.sha2(F.concat(F.substring(s["preimage"], F.lit(1), s["slot"] * HEX), now, F.substring(s["preimage"], s["slot"] * HEX + HEX + 1, F.lit(FAN * HEX))), 256)

    return F.aggregate(path, hash_, step)


def manifest(leaves: DataFrame) -> DataFrame:
    """Each leaf with its way to the root: the columns of leaves, subroot, root and path.

    leaves: source, doc_id, leaf and further columns.
    """
    place = run_dir(leaves.sparkSession, "merkle")
    rest = [c for c in leaves.columns if c != "source"]
    order = ["doc_id", "leaf", *(c for c in rest if c not in ("doc_id", "leaf"))]
    # The range sort reads its input twice; the digests are stored first, so that texts are hashed once.
    thin = materialize(leaves.select(tree_of(F.col("source")).alias("tree"), *rest), f"{place}/digests")
    nodes = ranked(thin, order, f"{place}/leaves")
    rounds, subroots = build(nodes.select("tree", "levels", "idx", F.col("leaf").alias("hash"), F.struct(*rest).alias("carry")), f"{place}/sources")
    # The tree of subroots; its nodes carry the names of their trees.
    tops = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash"), ["name"], f"{place}/subroots")
    upper, root = build(tops.select("tree", "levels", "idx", "hash", F.col("name").alias("carry")), f"{place}/top")
    none = F.array().cast("array<struct<preimage:string,slot:int>>")
    above = ancestors(upper, root.select("tree", none.alias("path"), F.col("hash").alias("root")))
    above = above.select(F.col("carry").alias("tree"), F.col("hash").alias("subroot"), "root", "path")
    return ancestors(rounds, above).select("carry.*", "subroot", "root", "path")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose identifier's crc32 is even lose their line ends; the siblings stay those of the whole data."""
    docs = read_table(spark, sf_dir, "documents").select(*FIELDS)
    own = [F.col(c) for c in FIELDS]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)) & F.contains("text", F.lit("\n"))
    leaves = docs.withColumn("leaf", leaf(*own))
    changed = F.when(hit, leaf(*own[:-1], F.replace("text", F.lit("\n"), F.lit("")))).otherwise(F.col("leaf"))
    rows = manifest(leaves.select("source", "doc_id", "leaf", changed.alias("now")))
    rows = rows.withColumn("folded_root", folded(F.col("now"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
