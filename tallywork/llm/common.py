"""Shared folders, tables and word rules of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]+"
NOT_WS = r"[^\x20\x09-\x0D]+"
#: The end id appended to each document.
END_ID = 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Without one, a session on this machine alone gets a folder of its own; any other gets an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or spark.conf.get("spark.tallywork.shared", None)
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tallywork-")
        atexit.register(shutil.rmtree, own, True)
        base = f"file://{own}"
        spark.conf.set("spark.tallywork.shared", base)
    return base.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh place below the shared folder for one run of an operator."""
    place = f"{shared_dir(spark)}/tallywork/{name}-{uuid.uuid4().hex[:12]}"
    for made in _recording:
        made.append(place)
    return place


_recording: list[list[str]] = []


@contextlib.contextmanager
def recorded():
    """The list of places that run_dir gives meanwhile."""
    made: list[str] = []
    _recording.append(made)
    try:
        yield made
    finally:
        _recording.remove(made)


def remove(spark: SparkSession, places: list[str]) -> None:
    """Delete places of run_dir that no result needs any more."""
    for place in places:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, place: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with __row, a number of each row, written and read back so that every later read has the same numbers."""
    return materialize(docs.withColumn("__row", F.monotonically_increasing_id()), run_dir(docs.sparkSession, name))


def file_system(place: str):
    """(file system, path) of a URI for plain reads and writes inside tasks."""
    from pyarrow import fs

    if place.startswith("file:"):
        place = "/" + place[5:].lstrip("/")
    place = re.sub("^s3[an]:", "s3:", place)
    return (fs.LocalFileSystem(), place) if place.startswith("/") else fs.FileSystem.from_uri(place)


@contextlib.contextmanager
def writing(place: str):
    """A stream for a file, which gets its name once it is whole: a retried or doubled task leaves one whole file."""
    fs, path = file_system(place)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with fs.open_output_stream(part) as out:
        yield out
    fs.move(part, path)


def write_whole(place: str, data: bytes) -> None:
    with writing(place) as out:
        out.write(data)


def local_view(place: str):
    """A numpy byte view of a file: memory-mapped where the shared folder is mounted, else read once."""
    import numpy as np

    fs, path = file_system(place)
    if type(fs).__name__ == "LocalFileSystem":
        return np.memmap(path, dtype=np.uint8, mode="r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=np.uint8)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bucket(doc_id, modulus: int):
    """crc32 of doc_id's decimal text modulo modulus (null: 0)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(0))


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, as UTF-8 bytes."""
    # bytes.lower() changes A-Z alone, and bytes.split() cuts at exactly U+0009-000D and space.
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def prefix_sums(df: DataFrame, key: str, order: str, size: str, out: str, tie: str) -> DataFrame:
    """Add out: the sum of size over the rows of the same key that come before by md5 of order's text, then size, then tie.

    No group is summed in one task: rows are dealt by (key, the digest's first three hex digits), each pair is summed
    where it lies, and only the pairs' totals (4096 rows a key at most) are summed along the key.
    """
    from pyspark.sql import Window

    at = df.withColumn("__o", F.md5(F.coalesce(F.col(order).cast("string"), F.lit("")).cast("binary")))
    at = at.withColumn("__b", F.substring("__o", 1, 3))
    totals = at.groupBy(key, "__b").agg(F.sum(size).alias("__t"))
    base = totals.withColumn("__base", F.sum("__t").over(Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)))
    base = base.select(F.col(key).alias("__k"), F.col("__b").alias("__bb"), F.coalesce("__base", F.lit(0)).alias("__base"))
    w = Window.partitionBy(key, "__b").orderBy("__o", size, tie).rowsBetween(Window.unboundedPreceding, -1)
    within = at.withColumn("__in", F.coalesce(F.sum(size).over(w), F.lit(0)))
    joined = within.join(base, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__b") == F.col("__bb")))
    return joined.withColumn(out, F.col("__base") + F.col("__in")).drop("__o", "__b", "__k", "__bb", "__base", "__in")
