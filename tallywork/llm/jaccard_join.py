"""N-gram Jaccard join: exact links between documents whose shingle sets overlap, by size-banded tiles.

A document's set holds the 64-bit hashes of its runs of five lower-cased words (with fewer words: all as one; without
words: nothing, and no links). Documents with one set are one class; classes are joined.

Tiles. Sets of sizes in one band, [2^k, 2^(k+1)), have their hashes dealt to m parts; a part's content is a signature.
Two sets with a Jaccard similarity of 0.8 differ in d <= size / 4 hashes, so in at most d parts. Signatures have one
global order (parts with more hashes first), and by the prefix principle two such sets share one of their first d + 1.
Each set therefore goes to the tiles of its first d + 1 signatures; sets close to their band's lower end also use the
band below. A set with no more than d parts filled also goes to the tiles of its s - ceil(0.8 s) + 1 smallest hashes: if
two linked sets have no part in common both do so, and they share one of those. No linked pair is missed.

Tests. A set's bitmap has the parity of its hashes in each of 1024 bits. Bits that differ need hashes that differ, so
their number bounds the overlap from above; pairs past that are intersected as sorted arrays. In each of `ROUNDS` rounds
every tile whose classes lie in several components names a leader; bitmaps compare each class with the leaders of its
tiles in other components, and the nearest is tested; then components are formed anew. In the end every pair in a tile
whose classes are still in different components is tested, a tile with many of them in blocks. So a group of n near
copies costs a few times n tests, and no tile is cut off.

Shingles and sets are told apart by 64-bit hashes. Rows without a doc_id count as larger than any; rows that share a
doc_id are documents of their own, told apart by a row number that is written first. An empty table gives no rows; further
columns of docs are kept by drop_near_copies(), whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_words, materialize, numbered, parts, read_table, run_dir
from .components import components

WIDTH = 5
#: Bytes of a parity bitmap; classes of a tile that one task compares with as many others; rows that may be broadcast.
BITMAP, BLOCK, SMALL = 128, 1024, 1 << 20
#: Smallest tiles of a class that its rows carry, and what fills up shorter lists.
FEW, NO_TILE = 8, (1 << 63) - 1
#: Classes of a tile up to which all its pairs are looked at in one go with other tiles'.
FEW_CLASSES = 48
ROUNDS = 2
#: Odd 64-bit multipliers, and what is added for raw hashes.
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
RAW = np.uint64(0x5851F42D4C957F2D)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = lower_words(text)
    n = len(words)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    if not n:
        return h
    size = min(n, width)
    total = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        total += h[j : n - size + 1 + j] * (ODD[j % 5] + np.uint64(2 * (j // 5)))
        total = mixed(total)
    return np.unique(total)


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(mixed(np.array([mixed(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def bitmap(s: np.ndarray) -> bytes:
    return np.packbits(np.bincount((s & np.uint64(8 * BITMAP - 1)).astype(np.int64), minlength=8 * BITMAP) & 1).tobytes()


def parts_of(band: int) -> int:
    """Parts of a band: enough that more than size / 4 of them are filled at the band's upper end."""
    a = 1 << band
    return math.ceil(0.6 * a + 2 * math.sqrt(a))


def tiles_of(s: np.ndarray) -> np.ndarray:
    """The tiles of a set."""
    n = len(s)
    if not n:
        return s
    band = n.bit_length() - 1
    need, raw, out = n // 4 + 1, False, []
    for k in (band, band - 1) if band and 4 * n < 5 << band else (band,):
        part = (s >> np.uint64(7)) % np.uint64(parts_of(k))
        order = np.argsort(part, kind="stable")
        p = part[order]
        at = np.concatenate(([0], np.flatnonzero(p[1:] != p[:-1]) + 1))
        filled = np.diff(np.append(at, n))
        sig = mixed(np.add.reduceat((s * ODD[0])[order], at) + p[at] * ODD[1] + np.array([k + 1], np.uint64) * ODD[2])
        if len(sig) < need:
            raw = True
        else:
            sig = sig[np.lexsort((sig, -filled))[:need]]
        out.append(sig)
    if raw:
        out.append(mixed(s[: n - (4 * n + 4) // 5 + 1] + RAW))
    return np.concatenate(out)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 |a & b| >= 80 |a | b| of sorted arrays."""
    if not len(a) or not len(b) or 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def may_link(na, nb, differ) -> np.ndarray:
    """Whether sets of these sizes, with so many bits that differ, can be linked: the overlap is at most (na + nb - differ) / 2."""
    most = (na + nb - differ) // 2
    return 5 * most >= 4 * (na + nb - most)


def signed(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, row (its number), sid, n (shingles), bits; per batch and bucket, with n = -1: tiles and their sids, packed.

    doc_id travels as text, since a column of integers with nulls would reach pandas as floats.
    """
    buckets = 8 * max(1, parts(docs.sparkSession))

    def run(batches):
        for pdf in batches:
            rows, done, tiles, owners = [], {}, [], []
            for d, k, text in zip(pdf["doc_id"], pdf["row"], pdf["text"], strict=True):
                s = shingles(text)
                sid = set_id(s) if len(s) else 0
                if len(s) and sid not in done:
                    t = tiles_of(s)
                    done[sid] = bitmap(s)
                    tiles.append(t)
                    owners.append(np.full(len(t), sid, np.int64))
                rows.append((d, k, sid, len(s), done.get(sid)))
            if not rows:
                continue
            ids, numbers, sids, n, bits = zip(*rows, strict=True)
            yield pd.DataFrame({"bucket": np.arange(len(rows), dtype=np.int32) % buckets, "doc_id": ids, "row": numbers, "sid": np.array(sids, np.int64), "n": n, "bits": bits, "tiles": None, "sids": None})
            if tiles:
                t, o = np.concatenate(tiles), np.concatenate(owners)
                bucket = (t >> np.uint64(40)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                t, o, bucket = t[order], o[order], bucket[order]
                at = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(t)]))
                yield pd.DataFrame({
                    "bucket": bucket[at[:-1]].astype(np.int32), "doc_id": None, "row": -1, "sid": 0, "n": -1, "bits": None,
                    "tiles": [t[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], "sids": [o[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)],
                })

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("__row").alias("row"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "bucket int, doc_id string, row long, sid long, n long, bits binary, tiles binary, sids binary")


def grouped(rows: DataFrame) -> DataFrame:
    """Rows of documents as they are, and, with n = -1, (tile, leader, sid) for each further class of a tile with several."""

    def run(batches):
        tiles, sids = [], []
        for pdf in batches:
            of_docs = pdf["n"] >= 0
            tiles += [np.frombuffer(x, np.int64) for x in pdf["tiles"][~of_docs]]
            sids += [np.frombuffer(x, np.int64) for x in pdf["sids"][~of_docs]]
            docs = pdf[of_docs]
            if len(docs):
                yield docs[["doc_id", "row", "sid", "n", "bits"]].assign(tile=0, leader=0)
        if tiles:
            t, s = np.concatenate(tiles), np.concatenate(sids)
            order = np.lexsort((s, t))
            t, s = t[order], s[order]
            new_tile = np.concatenate(([True], t[1:] != t[:-1]))
            first = np.maximum.accumulate(np.where(new_tile, np.arange(len(t)), 0))
            member = ~new_tile & np.concatenate(([False], (s[1:] != s[:-1]) | new_tile[1:]))
            at = np.flatnonzero(member)
            for i in range(0, len(at), 100_000):
                k = at[i : i + 100_000]
                yield pd.DataFrame({"doc_id": None, "row": -1, "sid": s[k], "n": -1, "bits": None, "tile": t[k], "leader": s[first[k]]})

    n = max(1, parts(rows.sparkSession))
    return rows.repartition(n, "bucket").mapInPandas(run, "doc_id string, row long, sid long, n long, bits binary, tile long, leader long").withColumn("doc_id", F.col("doc_id").cast("long"))


def bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs (sid, a, b) that sizes and bitmaps allow, with the number of bits that differ."""
    side = classes.select("sid", "n", "bits")
    both = pairs.join(side.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")).hint("merge"), "a")
    both = both.join(side.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb")).hint("merge"), "b")

    def bound(batches):
        for pdf in batches:
            if len(pdf):
                differ = np.bitwise_count(rows_of(pdf["ba"]) ^ rows_of(pdf["bb"])).sum(axis=1, dtype=np.int64)
                keep = may_link(pdf["na"].to_numpy(), pdf["nb"].to_numpy(), differ)
                yield pdf.loc[keep, ["sid", "a", "b"]].assign(differ=differ[keep])

    return both.select("sid", "a", "b", "na", "nb", "ba", "bb").mapInPandas(bound, "sid long, a long, b long, differ long")


def verified(left: DataFrame, classes: DataFrame, docs: DataFrame, place: str) -> DataFrame:
    """The pairs (a, b) of classes that are linked, by the arrays of one document of each."""
    needed = left.select(F.col("a").alias("sid")).union(left.select(F.col("b").alias("sid"))).distinct().join(classes.select("sid", "at").hint("merge"), "sid")
    needed = materialize(needed.select(F.col("sid").alias("__sid"), F.col("at").alias("__at")), f"{place}/needed")
    n_needed = needed.count()
    if not n_needed:
        return left
    # 16 bytes a row: up to 16 MB travel to the texts, otherwise texts and names meet in a merge join.
    few = F.broadcast(needed) if n_needed <= SMALL else needed.hint("merge")
    texts = docs.select("__row", F.coalesce("text", F.lit("")).alias("text")).join(few, F.col("__row") == F.col("__at"))
    texts = materialize(texts.select(F.col("__sid").alias("sid"), "text"), f"{place}/texts")
    rows = left.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    rows = rows.join(texts.select(F.col("sid").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")

    def exact(batches):
        for pdf in batches:
            keep = [linked(shingles(ta), shingles(tb)) for ta, tb in zip(pdf["ta"], pdf["tb"], strict=True)]
            yield pdf.loc[keep, ["a", "b"]]

    return materialize(rows.mapInPandas(exact, "a long, b long").distinct(), f"{place}/links")


def rows_of(bits: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), BITMAP // 8)


def opened(members: DataFrame, roots: DataFrame | None, turn: int) -> DataFrame:
    """Members (tile, sid, root, size, lead, lead_root) of the tiles with several components. A tile's lead is its class with the smallest hash, another one each turn."""
    m = members.select("tile", "sid")
    if roots is None:
        m = m.withColumn("root", F.col("sid"))
    else:
        m = m.join(roots.select(F.col("node").alias("sid"), "root").hint("merge"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    lead = F.min_by(F.struct("sid", "root"), F.struct(F.xxhash64("sid", F.lit(turn)), "sid"))
    tiles = m.groupBy("tile").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"), lead.alias("l")).filter("lo != hi")
    return m.join(tiles.select("tile", "size", F.col("l.sid").alias("lead"), F.col("l.root").alias("lead_root")).hint("merge"), "tile")


def proposed(members: DataFrame, tested: DataFrame | None) -> DataFrame:
    """sid, a, b: each class (sid) with the leads of its tiles in other components, without pairs (a, b) whose arrays were compared."""
    pairs = members.filter("root != lead_root").select("sid", F.least("sid", "lead").alias("a"), F.greatest("sid", "lead").alias("b")).distinct()
    return pairs if tested is None else pairs.join(tested.hint("merge"), ["a", "b"], "left_anti")


def pairs_within(pdf: pd.DataFrame) -> pd.DataFrame:
    """a and b of rows (tile, lo, hi, sid, root, n, bits, few; sorted) that share tile, lo and hi, have different roots and may link, named by the smallest tile of both."""
    if not len(pdf):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    tile, lo, hi, sid, root, n = (pdf[c].to_numpy() for c in ("tile", "lo", "hi", "sid", "root", "n"))
    bits, few = rows_of(pdf["bits"]), np.stack(pdf["few"].to_numpy())
    new = np.concatenate(([True], (tile[1:] != tile[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(tile)))
    group = np.repeat(np.arange(len(at)), size)
    found = []

    def test(x: np.ndarray, y: np.ndarray) -> None:
        ok = np.flatnonzero((root[x] != root[y]) & (5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y])))
        x, y = x[ok], y[ok]
        if len(x):
            ok = np.flatnonzero(may_link(n[x], n[y], np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)))
            x, y = x[ok], y[ok]
            smaller = (few[x][:, :, None] == few[y][:, None, :]) & (few[x] < tile[x][:, None])[:, :, None]
            ok = np.flatnonzero(~smaller.any(axis=(1, 2)))
            found.append((sid[x[ok]], sid[y[ok]]))

    # In small tiles each class meets the next one, the one after that, and so on, all tiles at once.
    x, d = np.flatnonzero(size[group] <= FEW_CLASSES), 0
    while len(x):
        d += 1
        x = x[x + d < len(tile)]
        x = x[group[x + d] == group[x]]
        test(x, x + d)
    for g in np.flatnonzero(size > FEW_CLASSES).tolist():
        k = np.arange(at[g], at[g] + size[g])
        names, of = np.unique(root[k], return_inverse=True)
        # Of two classes in different components, one at least is outside the commonest.
        for i in k[of != np.bincount(of).argmax()] if len(names) > 1 else ():
            test(np.full(len(k), i), k)
    a, b = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def apart(members: DataFrame, classes: DataFrame, tested: DataFrame, place: str) -> DataFrame:
    """Pairs (a, b) of classes in one tile and different components that size and bitmap allow, without those tested.

    Near copies share most of their tiles: a pair is left to a smaller tile where the lists of both have it. Of the tiles
    that a pair shares, the smallest always names it.
    """
    members = members.select("tile", "sid", "root", "size")
    few = F.slice(F.concat(F.sort_array(F.collect_set("tile")), F.array_repeat(F.lit(NO_TILE), FEW)), 1, FEW)
    side = classes.select("sid", "n", "bits").join(members.groupBy("sid").agg(few.alias("few")).hint("merge"), "sid")
    members = members.join(side.hint("merge"), "sid")
    # Blocks of a tile meet two by two.
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("sid", F.lit(1)), blocks).cast("int")
    members = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = members.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    members = members.repartition(max(1, parts(members.sparkSession)), "tile", "lo", "hi").sortWithinPartitions("tile", "lo", "hi")

    def run(batches):
        kept = None
        for pdf in batches:
            kept = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
            last = kept.iloc[-1]
            same = (kept["tile"] == last["tile"]) & (kept["lo"] == last["lo"]) & (kept["hi"] == last["hi"])
            yield pairs_within(kept[~same])
            kept = kept[same]
        if kept is not None:
            yield pairs_within(kept)

    out = members.select("tile", "lo", "hi", "sid", "root", "n", "bits", "few").mapInPandas(run, "a long, b long").distinct()
    return materialize(out.join(tested.hint("merge"), ["a", "b"], "left_anti"), f"{place}/apart")


def settled(docs: DataFrame) -> DataFrame:
    """One row per row of docs, which have __row: doc_id, row, n_shingles, sid (its class; 0 without shingles), root (null without shingles), component_id."""
    spark = docs.sparkSession
    place = run_dir(spark, "jaccard")
    rows = materialize(grouped(signed(docs)), f"{place}/rows")
    members = rows.filter("n >= 0").select("doc_id", "row", "sid", "n", "bits")
    tiles = rows.filter("n < 0").select("tile", "leader", "sid")
    classes = members.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.min("row").alias("at"), F.max("n").alias("n"), F.max("bits").alias("bits"))
    classes = materialize(classes, f"{place}/classes")
    in_tiles, roots, tested = tiles.select("tile", "sid").union(tiles.select("tile", F.col("leader").alias("sid")).distinct()), None, None
    for turn in range(ROUNDS + 1):
        here = f"{place}/{turn}"
        in_tiles = materialize(opened(in_tiles, roots, turn), f"{here}/members")
        if turn < ROUNDS:
            near = bounded(proposed(in_tiles, tested), classes)
            left = materialize(near.groupBy("sid").agg(F.min_by(F.struct("a", "b"), F.struct("differ", "a", "b")).alias("p")).select("p.a", "p.b").distinct(), f"{here}/nearest")
            tested = left if tested is None else tested.union(left)
        else:
            left = apart(in_tiles, classes, tested, here)
        links = verified(left, classes, docs, here)
        # What earlier rounds joined is a star by now.
        joined = links if roots is None else links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = materialize(components(joined, f"{here}/stars"), f"{here}/roots")
    at = classes.select("sid", "rep").join(roots.select(F.col("node").alias("sid"), "root").hint("merge"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = at.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = at.join(least.hint("merge"), "root").select("sid", "root", "component_id")
    out = members.select("doc_id", "row", F.col("n").alias("n_shingles"), "sid").join(named.hint("merge"), "sid", "left")
    return out.select("doc_id", "row", "n_shingles", "sid", "root", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def join_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, sid (its class; 0 without shingles), component_id."""
    return settled(numbered(docs.select("doc_id", "text"), "near-rows")).select("doc_id", "n_shingles", "sid", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (null is larger than any) and, of those, the first by number."""
    rows = numbered(docs, "near-rows")
    # Rows without shingles are each on their own.
    found = settled(rows).withColumn("alone", F.when(F.col("root").isNull(), F.col("row")))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"]
    stay = found.groupBy("root", "alone").agg(first.alias("__stay"))
    return rows.join(stay.select("__stay"), F.col("__row") == F.col("__stay"), "left_semi").select(*docs.columns)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
