"""Exact deduplication through an extendible-hash index on shared files.

Texts are equal when their normalised forms (each run of white space becomes one space; null is empty) have the same
bytes. A map step reduces each batch to its distinct texts. Owner tasks take ranges of the 64-bit hash in ascending order:
each inserts its rows into an extendible-hash index, where an overfull bucket is split by one more hash bit and the
directory doubles when that bucket was as deep as the directory. Texts of equal hash arrive one after another; their
bytes are compared, and different ones are chained in their bucket as entries of their own. An index is written to the
shared folder when it has `FILE` entries and its next hash is another one, so an owner holds no more than that and the
texts of one hash. Every row then looks its group up: directory slot, bucket, chained hashes, digest. Rows are
range-sorted by digest for that, and a text with very many copies is split among ranges.

Every row counts in group_size, repeated rows too. The smallest doc_id of a group stays (null is larger than any); in
resolve() and drop_copies() all rows with that doc_id and text do, so repeated rows share one outcome. one_of_each()
leaves one row of each group. Empty texts form one group. An empty table gives no rows; further columns of docs are kept
by drop_copies() and one_of_each(), whatever their names.
"""

from __future__ import annotations

import functools
import struct
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, local_view, materialize, numbered, parts, read_table, run_dir, write_whole

#: Entries of a bucket before it is split; entries of an index file before the next one is begun.
PAGE, FILE = 64, 1 << 19
#: Leading hash bits that deal rows to owners; the directory goes by the lowest bits.
OWNER_BITS = 16
MAX_ID = (1 << 63) - 1
#: An entry: smallest doc_id, rows, bytes of the text, SHA-256.
ENTRY = np.dtype([("doc_id", "<i8"), ("rows", "<i8"), ("size", "<i8"), ("sha", "S32")])


class HashIndex:
    """An extendible-hash index over (hash, text). Equal hashes must be added one after another."""

    def __init__(self, page: int = PAGE):
        self.page = page
        self.depth = self.n = 0
        self.directory = [[0, []]]  # slot: a bucket [local depth, entries]; slots may share one
        self.now: int | None = None
        self.chain: list[tuple[bytes, list]] = []  # texts of the hash that was added last, with their entries

    def add(self, h: int, sha: bytes, text: bytes, doc_id: int, rows: int) -> None:
        if h != self.now:
            self.now, self.chain = h, []
        for known, e in self.chain:
            if known == text:
                e[1], e[2] = min(e[1], doc_id), e[2] + rows
                return
        e = [h, doc_id, rows, len(text), sha]
        self.chain.append((text, e))
        self.n += 1
        bucket = self.directory[h & ((1 << self.depth) - 1)]
        bucket[1].append(e)
        while len(bucket[1]) > self.page and any(x[0] != h for x in bucket[1]):
            bucket = self.split(bucket, h)

    def split(self, bucket: list, h: int) -> list:
        """Split the bucket by its next bit and return the half where h belongs."""
        local = bucket[0]
        if local == self.depth:
            self.directory += self.directory
            self.depth += 1
        halves = [local + 1, []], [local + 1, []]
        for e in bucket[1]:
            halves[e[0] >> local & 1][1].append(e)
        for i in range(h & ((1 << local) - 1), len(self.directory), 1 << local):
            self.directory[i] = halves[i >> local & 1]
        return halves[h >> local & 1]

    def to_bytes(self) -> bytes:
        """depth; for each directory slot the position of its page; pages: count, hashes, entries."""
        pages, at, where = [], 8 + 8 * len(self.directory), {}
        for b in self.directory:
            if id(b) not in where:
                where[id(b)] = at
                entries = np.array([tuple(e[1:]) for e in b[1]], ENTRY)
                pages.append(struct.pack("<Q", len(b[1])) + np.array([e[0] for e in b[1]], "<u8").tobytes() + entries.tobytes())
                at += len(pages[-1])
        return struct.pack("<Q", self.depth) + np.array([where[id(b)] for b in self.directory], "<u8").tobytes() + b"".join(pages)


class IndexFile:
    """Reads single pages of a mapped index file."""

    def __init__(self, place: str):
        self.data = local_view(place)
        self.mask = (1 << int(self.data[:8].view("<u8")[0])) - 1

    def chained(self, h: int) -> np.ndarray:
        """The entries of a hash."""
        slot = 8 + 8 * (h & self.mask)
        at = int(self.data[slot : slot + 8].view("<u8")[0])
        n = int(self.data[at : at + 8].view("<u8")[0])
        at += 8
        hit = np.flatnonzero(self.data[at : at + 8 * n].view("<u8") == np.uint64(h))
        return self.data[at + 8 * n : at + (8 + ENTRY.itemsize) * n].view(ENTRY)[hit]

    def find(self, h: int, sha: bytes) -> tuple[int, int] | None:
        """(smallest doc_id, rows) of a text."""
        for e in self.chained(h):
            if e["sha"].ljust(32, b"\0") == sha:  # numpy drops zeros at the end
                return int(e["doc_id"]), int(e["rows"])
        return None


@functools.lru_cache(8)
def index_file(place: str) -> IndexFile:
    return IndexFile(place)


def row_of(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c == "__row"]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, norm and sha (hex of its SHA-256) of each row, and __row where docs has it."""
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), WS, " ")
    return docs.select("doc_id", *row_of(docs), norm.alias("norm")).withColumn("sha", F.sha2(F.encode("norm", "UTF-8"), 256))


def combined(batches):
    """The distinct texts of each batch: owner, sha, text, smallest doc_id, rows."""
    for pdf in batches:
        g = pdf.groupby(["sha", "norm"], sort=False)["doc_id"].agg(["min", "size"]).reset_index()
        owner = g["sha"].str[: OWNER_BITS // 4].map(lambda x: int(x, 16))
        yield pd.DataFrame({"owner": owner.astype("int32"), "sha": g["sha"], "norm": g["norm"], "doc_id": g["min"], "n": g["size"].astype("int64")})


def build_index(docs: DataFrame, place: str) -> DataFrame:
    """Write the index files of all owners below place; file, first and last (16 hex digits of the hashes) of each."""
    owners = max(1, parts(docs.sparkSession))
    rows = keyed(docs).drop("__row").withColumn("doc_id", F.coalesce("doc_id", F.lit(MAX_ID))).mapInPandas(combined, "owner int, sha string, norm string, doc_id long, n long")
    # Contiguous ranges of the leading hash bits, one a task.
    ranged = rows.withColumn("owner", F.floor(F.col("owner") * owners / (1 << OWNER_BITS)).cast("int"))

    def own(batches):
        index, first, last = HashIndex(), None, ""

        def close():
            file = f"{place}/{first}.index"
            write_whole(file, index.to_bytes())
            return pd.DataFrame({"file": [file], "first": [first], "last": [last]})

        for pdf in batches:
            for sha, norm, d, n in zip(pdf["sha"], pdf["norm"], pdf["doc_id"], pdf["n"], strict=True):
                key = sha[:16]
                if index.n >= FILE and key != last:
                    yield close()
                    index, first = HashIndex(), None
                first, last = first or key, key
                index.add(int(key, 16), bytes.fromhex(sha), norm.encode("utf-8", "surrogatepass"), int(d), int(n))
        if index.n:
            yield close()

    return ranged.repartitionById(owners, "owner").sortWithinPartitions("sha").mapInPandas(own, "file string, first string, last string")


def resolve(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and __row where docs has it."""
    spark = docs.sparkSession
    place = run_dir(spark, "exact")
    # A row for each index file.
    files = materialize(build_index(docs, place), f"{place}/files").orderBy("last").collect()
    names, lasts = [r["file"] for r in files], [r["last"] for r in files]

    @F.pandas_udf("keep_id long, group_size long")
    def looked_up(sha: pd.Series) -> pd.DataFrame:
        own = sha.unique()
        found = {x: index_file(names[bisect_left(lasts, x[:16])]).find(int(x[:16], 16), bytes.fromhex(x)) for x in own}
        return pd.DataFrame([found[x] for x in sha], columns=["keep_id", "group_size"])

    rows = keyed(docs).select("doc_id", *row_of(docs), "sha", F.monotonically_increasing_id().alias("__n"))
    rows = materialize(rows, f"{place}/rows").repartitionByRange(max(1, parts(spark)), "sha", "__n").sortWithinPartitions("sha")
    out = rows.withColumn("g", looked_up("sha")).withColumn("keep_id", F.when(F.col("g.keep_id") != MAX_ID, F.col("g.keep_id")))
    # An identifier may be the largest number there is.
    out = out.withColumn("keep_id", F.coalesce("keep_id", F.when(F.col("doc_id") == MAX_ID, F.col("doc_id"))))
    return out.select("doc_id", "keep_id", F.col("g.group_size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"), *row_of(docs))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row with a smaller doc_id has."""
    gone = resolve(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("text_sha256").alias("__sha")).distinct()
    own = F.sha2(F.encode(F.regexp_replace(F.coalesce(docs["text"], F.lit("")), WS, " "), "UTF-8"), 256)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]) & (own == gone["__sha"]), "left_anti")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each text: that of the smallest doc_id (null is larger than any) and, of those, the first by number."""
    rows = numbered(docs, "exact-rows")
    first = F.min(F.struct(~F.col("kept"), F.col("doc_id").isNull(), "doc_id", "__row"))["__row"]
    stay = resolve(rows).groupBy("text_sha256").agg(first.alias("__stay"))
    return rows.join(stay, F.col("__row") == F.col("__stay"), "left_semi").select(*docs.columns)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(read_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
