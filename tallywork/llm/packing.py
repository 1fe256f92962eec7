"""Packing documents into sequences along a space-filling curve.

Each document's token ids are counted in `WIDTH` hashed dimensions, the square roots of the counts are scaled to length
one and projected to `DIMS` dimensions by fixed random signs, and each coordinate is squashed and cut to `BITS` bits. The
Hilbert index of that cell is the document's key. Documents are range-sorted by (key, doc_id), their ids with the end id
are laid one after another, and this stream is cut every `length` ids. So a sequence holds neighbours on the curve, and
only the last one can need padding. With `window`, a column of docs, documents are sorted by it before the key: so an order
that docs have already, such as a curriculum's, holds among windows and the curve orders each of them.

Null texts are empty: such a document is its end id alone. Rows with the same doc_id are documents of their own. Copies
of one text share a key; doc_id parts them, so no range is larger for it. An empty table gives no pieces; further columns of
docs are not read.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import END_ID, materialize, parts, read_table, run_dir
from .tokens import encoder, vocabulary

LENGTH = 2048
WIDTH, DIMS, BITS = 256, 4, 10


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert indices of integer points, an n x d array of values below 2**bits.

    Each point's coordinates are turned, from the highest bit down, into those of the curve's sub-cube (exchange or
    invert the low bits), then Gray-decoded across dimensions, and the bits are interleaved.
    """
    x = cells.astype(np.uint64).T.copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] & np.uint64(1 << b)) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= flip
    out = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return out.astype(np.int64)


@functools.cache
def projection(vocab: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The hashed dimension of each id, and the signs that project them."""
    rng = np.random.default_rng(seed)
    dim_of = rng.integers(0, WIDTH, vocab)
    signs = rng.choice([-1.0, 1.0], (WIDTH, DIMS))
    return dim_of, signs - signs.mean(axis=0)


def curve_keys(ids: list[np.ndarray], vocab: int) -> np.ndarray:
    """The Hilbert key of each array of token ids."""
    dim_of, signs = projection(vocab)
    v = np.zeros((len(ids), WIDTH))
    for i, x in enumerate(ids):
        v[i] = np.bincount(dim_of[x], minlength=WIDTH)
    v = np.sqrt(v)
    v /= np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))
    cells = np.floor((1 << BITS) / (1 + np.exp(-3.0 * (v @ signs)))).astype(np.int64)
    return hilbert_index(np.clip(cells, 0, (1 << BITS) - 1))


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID, window: Column | None = None) -> DataFrame:
    """rid (a number of the row), window (as text), doc_id, key, n_tokens and ids (little-endian, two bytes where the vocabulary allows)."""

    def run(batches):
        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        for pdf in batches:
            raw = [x + end for x in enc.encode(list(pdf["text"]))]
            ids = [np.frombuffer(x, enc.dtype) for x in raw]
            keys = curve_keys(ids, enc.size) if ids else np.zeros(0, np.int64)
            yield pd.DataFrame({"rid": pdf["rid"], "window": pdf["window"], "doc_id": pdf["doc_id"], "key": keys, "n_tokens": np.array([len(x) for x in ids], np.int64), "ids": raw})

    # doc_id travels as text: a column of integers with nulls would reach pandas as floats.
    at = (F.lit("") if window is None else window.cast("string")).alias("window")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), at, F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "rid long, window string, doc_id string, key long, n_tokens long, ids binary").withColumn("doc_id", F.col("doc_id").cast("long"))


def starts(rows: DataFrame, place: str) -> DataFrame:
    """rid and at (ids before the document in the whole stream) by (window, key, doc_id).

    Only keys and lengths are range-sorted. Each range sums its own lengths; one total a range is summed across ranges.
    """
    n = max(1, parts(rows.sparkSession))
    by = ("window", "key", "doc_id", "rid")
    ranged = rows.select(*by, "n_tokens").repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()).select("rid", "n_tokens", "part")

    def run(batches):
        at = 0
        for pdf in batches:
            sums = pdf["n_tokens"].cumsum()
            yield pd.DataFrame({"rid": pdf["rid"], "part": pdf["part"], "upto": at + sums, "inside": at + sums - pdf["n_tokens"]})
            at += int(sums.iloc[-1]) if len(sums) else 0

    placed = materialize(ranged.mapInPandas(run, "rid long, part int, upto long, inside long"), f"{place}/order")
    totals = placed.groupBy("part").agg(F.max("upto").alias("total"))
    base = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # One row for each range, a number that the shuffle partitions fix.
    return placed.join(F.broadcast(base), "part").select("rid", (F.col("base") + F.col("inside")).alias("at"))


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = True, window: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids where wanted.

    ids holds the piece's token ids as little-endian unsigned 32-bit integers.
    """
    spark = docs.sparkSession
    place = run_dir(spark, "pack")
    rows = materialize(tokenised(docs, path, end_id, window), f"{place}/ids")
    placed = rows.select("rid", F.col("doc_id").cast("string").alias("doc_id"), "n_tokens", "ids").join(starts(rows, place), "rid")

    def cut(batches):
        for pdf in batches:
            out = []
            for d, n, raw, at in zip(pdf["doc_id"], pdf["n_tokens"], pdf["ids"], pdf["at"], strict=True):
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                p = 0
                while p < n:
                    sequence, offset = divmod(at + p, length)
                    size = min(length - offset, n - p)
                    piece = ids[p : p + size].tobytes()
                    out.append((d, p, size, zlib.crc32(piece), n, sequence, offset, piece if with_ids else None))
                    p += size
            cols = list(zip(*out, strict=True)) or [[]] * 8
            made = dict(zip(("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), (np.array(x, np.int64) for x in cols[1:7]), strict=True))
            yield pd.DataFrame({"doc_id": list(cols[0])} | made | {"ids": list(cols[7])})

    pieces = placed.mapInPandas(cut, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    pieces = pieces.withColumn("doc_id", F.col("doc_id").cast("long"))
    return pieces if with_ids else pieces.drop("ids")


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), with_ids=False)
