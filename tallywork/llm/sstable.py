"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of key. Keys are nine bytes that sort as doc_id does (null first). A block
holds up to `block` bytes of entries; an entry is: bytes shared with the key before, bytes of the rest, bytes of the value
(varints), rest, value. The value is the document's ids as little-endian integers. Blocks are followed by a sparse index
(each block's first key, place and length), a Bloom filter of keys, and a fixed footer with the places of both, the
number of documents and ids, and a mark. A lookup reads the footer, the Bloom filter and the index, searches the index
by bisection and scans one block (and the following ones, where a repeated key goes on).

A writer holds one open block, the index and the keys; blocks go to the file as they close, and a range of documents goes
on in a further file when one has `LIMIT` bytes, so a text may be of any length. Repeated doc_ids stay as entries of their
own, in order of their text's hash, and rows without one come first; however many rows share an identifier, or have none,
ranges are cut between their texts, so one key may go on in several shards. Null texts are empty and hold the end id alone.
An empty table gives no files and no rows; further columns of docs are not read.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import END_ID, file_system, parts, read_table, run_dir, writing
from .tokens import encoder, vocabulary

#: Bytes of a block and of a file.
BLOCK, LIMIT = 1 << 16, 1 << 28
BLOOM_BITS, BLOOM_HASHES = 10, 7
MARK = b"TWSST001"
#: Bytes of a key.
KEY = 9
#: Places of index and Bloom filter, their lengths, documents, ids, bytes of an id, mark.
FOOTER = struct.Struct("<QQQQQQQ8s")


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if not key[0] else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes one shard to a stream."""

    def __init__(self, out, id_bytes: int, block: int = BLOCK):
        self.out, self.id_bytes, self.block = out, id_bytes, block
        self.at = self.n_ids = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys = bytearray()
        self.now: list[bytes] = []
        self.now_bytes, self.first, self.last = 0, b"", b""

    @property
    def n_docs(self) -> int:
        return len(self.keys) // KEY

    def add(self, key: bytes, value: bytes) -> None:
        if not self.now:
            self.first, shared = key, 0
        else:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=True)) if x != y), len(key))
        entry = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.now.append(entry)
        self.now_bytes += len(entry)
        self.last = key
        self.keys += key
        self.n_ids += len(value) // self.id_bytes
        if self.now_bytes >= self.block:
            self.close_block()

    def close_block(self) -> None:
        if self.now:
            self.out.write(b"".join(self.now))
            self.index.append((self.first, self.at, self.now_bytes))
            self.at += self.now_bytes
            self.now, self.now_bytes = [], 0

    def finish(self) -> None:
        self.close_block()
        index = b"".join(k + struct.pack("<QQ", a, n) for k, a, n in self.index)
        bits = max(64, BLOOM_BITS * self.n_docs)
        bloom = np.zeros(bits, bool)
        for i in range(0, len(self.keys), KEY):
            bloom[bloom_places(bytes(self.keys[i : i + KEY]), bits)] = True
        packed = struct.pack("<Q", bits) + np.packbits(bloom).tobytes()
        self.out.write(index + packed + FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.n_docs, self.n_ids, self.id_bytes, MARK))


class ShardReader:
    """Reads a shard by ranges: the footer, index and filter at once, blocks as they are needed."""

    def __init__(self, place: str):
        fs, path = file_system(place)
        self.f = fs.open_input_file(path)
        end = self.f.size()
        at, n, bloom_at, bloom_n, self.n_docs, self.n_ids, self.id_bytes, mark = FOOTER.unpack(self.range(end - FOOTER.size, FOOTER.size))
        if mark != MARK:
            raise ValueError(f"{place} is no shard")
        raw = self.range(at, n)
        self.index = [(raw[i : i + 9], *struct.unpack_from("<QQ", raw, i + 9)) for i in range(0, n, 25)]
        self.firsts = [x[0] for x in self.index]
        bloom = self.range(bloom_at, bloom_n)
        (self.bits,) = struct.unpack_from("<Q", bloom)
        self.bloom = np.unpackbits(np.frombuffer(bloom, np.uint8, offset=8))

    def range(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def block(self, i: int):
        """(key, value) of each entry of a block."""
        _, at, n = self.index[i]
        data, p, key = self.range(at, n), 0, b""
        while p < n:
            shared, p = read_varint(data, p)
            rest, p = read_varint(data, p)
            size, p = read_varint(data, p)
            key = key[:shared] + data[p : p + rest]
            yield key, data[p + rest : p + rest + size]
            p += rest + size

    def __iter__(self):
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[bytes]:
        """The values of a key; none where it is absent."""
        key = key_of(doc_id)
        if not self.bloom[bloom_places(key, self.bits)].all():
            return []
        found, i = [], max(0, bisect_left(self.firsts, key) - 1)
        while i < len(self.index) and self.firsts[i] <= key:
            found += [v for k, v in self.block(i) if k == key]
            i += 1
        return found


def write_shards(docs: DataFrame, path: str, place: str, end_id: int = END_ID, limit: int = LIMIT) -> DataFrame:
    """Write docs' token ids as shards below place. One row a file: shard, piece, file, first, n_docs, n_ids; (shard, piece) ascend by key."""
    n = max(1, parts(docs.sparkSession))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    # As text: a column of integers with nulls would reach pandas as floats.
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.spark_partition_id().alias("shard"))

    def entries(batches, enc):
        """shard, doc_id and ids of each document."""
        end = np.array([end_id], enc.dtype).tobytes()
        for pdf in batches:
            yield from zip(pdf["shard"], (None if d is None else int(d) for d in pdf["doc_id"]), (x + end for x in enc.encode(list(pdf["text"]))), strict=True)

    def write(batches):
        enc, piece = encoder(path), 0
        got = entries(batches, enc)
        held = next(got, None)
        while held is not None:
            shard, first = held[:2]
            file = f"{place}/{shard:06d}-{piece:06d}.sst"
            with writing(file) as stream:
                out = ShardWriter(stream, enc.dtype.itemsize)
                while held is not None and out.at < limit:
                    out.add(key_of(held[1]), held[2])
                    held = next(got, None)
                out.finish()
            yield pd.DataFrame({"shard": [shard], "piece": [piece], "file": [file], "first": [None if first is None else str(first)], "n_docs": [out.n_docs], "n_ids": [out.n_ids]})
            piece += 1

    return rows.mapInPandas(write, "shard int, piece int, file string, first string, n_docs long, n_ids long").withColumn("first", F.col("first").cast("long"))


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shard files.

    Where files begin follows from sums over one row a file.
    """
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = shards.withColumn("start", before).repartition(max(1, parts(shards.sparkSession)), "file")

    def read(batches):
        for pdf in batches:
            for file, start in zip(pdf["file"], pdf["start"], strict=True):
                r, at = ShardReader(file), int(start)
                rows: list[tuple] = []
                for key, value in r:
                    ids = np.frombuffer(value, f"<u{r.id_bytes}")
                    rows.append((id_of(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) == 10_000:
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)

    def frame(rows):
        cols = list(zip(*rows, strict=True))
        return pd.DataFrame({"doc_id": [None if x is None else str(x) for x in cols[0]], "start": cols[1], "n_tokens": cols[2], "ids_crc32": cols[3]})

    return placed.mapInPandas(read, "doc_id string, start long, n_tokens long, ids_crc32 long").withColumn("doc_id", F.col("doc_id").cast("long"))


def op3_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = run_dir(spark, "sstable")
    write_shards(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), place).write.parquet(f"{place}/shards")
    return read_shards(spark.read.parquet(f"{place}/shards"))
