"""Keyed tables on Parquet: latest-wins merges into versions.

A table is a folder of versions; each merge writes the next one whole and then moves the pointer, so readers see one
version or the other, and a repeated batch id changes nothing.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .files import delete, folders, read_text, write_text


def shared_place(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that spark.checkpoint.dir names; on this machine alone, one of its own that goes with the process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tallywork-")
        atexit.register(shutil.rmtree, own, True)
        base = own
    return f"{base.rstrip('/')}/tallywork/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder that spark.checkpoint.dir names; a session on this machine alone may do without the setting."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        place = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not place and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(place or shared_place(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df, which the join that it is put into deals out by its keys and never sends whole through the driver.

    Spark goes by estimates from the sizes of files, which are many times smaller than their rows in memory, and which know
    nothing of what explode adds: a table that grows with the input is then a broadcast of hundreds of MB.
    """
    return df.hint("merge")


def latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of each key that is largest by order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, *(F.col("__r")[c].alias(c) for c in rest))


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """stored with changes in place of its rows of the same keys; columns of keep are set on the first sight of a key alone."""
    s = stored.select(*stored.columns, F.lit(True).alias("__old"))
    c = changes.select(*(F.col(x).alias(f"__{x}" if x not in keys else x) for x in changes.columns), F.lit(True).alias("__new"))
    rows = s.join(c, keys, "full")

    def value(x: str) -> Column:
        if x in keys or x not in changes.columns:
            return F.col(x)
        if x in keep:
            return F.when(F.col("__old").isNotNull(), F.col(x)).otherwise(F.col(f"__{x}")).alias(x)
        return F.when(F.col("__new").isNotNull(), F.col(f"__{x}")).otherwise(F.col(x)).alias(x)

    return rows.select(*(value(x) for x in stored.columns))


def patch(stored: DataFrame, changes: DataFrame, keys: list[str], clear: tuple[str, ...] = ()) -> DataFrame:
    """stored with the non-null values of changes; columns of clear take nulls too."""
    c = changes.select(*(F.col(x).alias(f"__{x}" if x not in keys else x) for x in changes.columns), F.lit(True).alias("__new"))
    rows = stored.join(c, keys, "left")

    def value(x: str) -> Column:
        if x in keys or x not in changes.columns:
            return F.col(x)
        if x in clear:
            return F.when(F.col("__new").isNotNull(), F.col(f"__{x}")).otherwise(F.col(x)).alias(x)
        return F.coalesce(f"__{x}", x).alias(x)

    return rows.select(*(value(x) for x in stored.columns))


def places(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with place, from 0 on by order among the rows of the same key.

    Ranges of (key, order) are sorted and stored; for each key only the counts of its ranges are summed, so a key of very
    many rows is spread over tasks.
    """
    at = rows.repartitionByRange(key, order).sortWithinPartitions(key, order).withColumns({"__n": F.monotonically_increasing_id(), "__range": F.spark_partition_id()})
    at = cut(at)
    runs = at.groupBy(key, "__range").agg(F.min("__n").alias("__first"), F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col(key).alias("__key"), F.col("__range").alias("__of"), "__first", before.alias("__before"))
    out = at.join(runs, at[key].eqNullSafe(runs["__key"]) & (at["__range"] == runs["__of"]))
    return out.withColumn("place", F.col("__n") - F.col("__first") + F.col("__before")).drop("__n", "__range", "__key", "__of", "__first", "__before")


class DuplicateName(ValueError):
    """A user's new category has the name of one that is there."""


def insert_new(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored and new; DuplicateName if a key of new is there already."""
    if not new.join(stored.select(*keys), keys, "left_semi").isEmpty():
        raise DuplicateName(f"{', '.join(keys)} is there already")
    return stored.unionByName(new, allowMissingColumns=True)


class Table:
    """Versions of a table below a folder; the last batch id is kept with the version."""

    def __init__(self, spark: SparkSession, place: str, schema: str):
        self.spark, self.place, self.schema = spark, place.rstrip("/"), schema

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> tuple[int, int]:
        """(version, batch id) of the newest whole version; (0, -1) if there is none."""
        fs, p = self._fs(self.place)
        found = [(0, -1)]
        if fs.exists(p):
            for s in fs.listStatus(p):
                name = s.getPath().getName()
                done = self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")
                if name.startswith("v") and fs.exists(done):
                    found.append(tuple(map(int, name[1:].split("-"))))
        return max(found)

    def read(self) -> DataFrame:
        n, batch = self.version()
        if not n:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.place}/v{n}-{batch}")

    def replace(self, df: DataFrame, batch: int = 0) -> bool:
        """Write df as the next version; False, and no write, if this batch id (above 0 from streams) was the last."""
        n, last = self.version()
        if n and batch and batch <= last:
            return False
        df.write.mode("overwrite").parquet(f"{self.place}/v{n + 1}-{batch}")
        self.prune(n)
        return True

    def prune(self, oldest: int) -> None:
        """Remove versions before oldest: the newest and the one that its writer read stay."""
        fs, p = self._fs(self.place)
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name.startswith("v") and int(name[1:].split("-")[0]) < oldest:
                fs.delete(s.getPath(), True)


class Manifest:
    """Tables below a folder, of which one file names the current versions: a change of several tables is seen whole or not at all."""

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place = spark, place.rstrip("/")

    def versions(self) -> dict[str, str]:
        """The folder of each table's version."""
        return json.loads(read_text(f"{self.place}/current.json") or "{}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.place}/{name}/{self.versions()[name]}")

    def switch(self, tables: dict[str, DataFrame]) -> None:
        """Write new versions of tables, then name them all at once. What neither the new nor the old list names is removed, also of earlier changes that were stopped."""
        old = self.versions()
        new = old | {name: uuid.uuid4().hex for name in tables}
        for name, df in tables.items():
            df.write.parquet(f"{self.place}/{name}/{new[name]}")
        write_text(f"{self.place}/current.json", json.dumps(new))
        for name in new:
            for version in folders(f"{self.place}/{name}") - {new[name], old.get(name)}:
                delete(f"{self.place}/{name}/{version}")


def erase_user(manifest: Manifest, user_id) -> dict[str, int]:
    """Remove a user from every table at once; how many rows of each were the user's, counted on the way."""
    seen, left = {}, {}
    for name in manifest.versions():
        df = manifest.read(name)
        mine = F.col("user_id").eqNullSafe(F.lit(user_id))
        seen[name] = Observation()
        left[name] = df.observe(seen[name], F.count(F.when(mine, 1)).alias("n")).filter(~mine)
    manifest.switch(left)
    return {name: o.get["n"] for name, o in seen.items()}
