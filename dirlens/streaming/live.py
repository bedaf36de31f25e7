"""A table of every mount's newest version that is kept by a stream and read while it changes.

A batch writes only the mounts that it touches, each merged with what is live of it, into a folder of its own, and then
publishes a list of what is live now. So a batch costs what it brings and the mounts it touches, however many came
before; a reader sees one list's folders, which stay for a time of grace after they are superseded."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from dirlens.sources.files import file_system

#: How long folders stay that no list names any more, and how many lists, the newest included.
GRACE, LISTS = 3600, 5


def _lists(spark: SparkSession, path: str) -> list[int]:
    """The batches whose list is complete, newest first."""
    fs, p = file_system(spark, f"{path}/live")
    names = [x.getPath() for x in fs.listStatus(p)] if fs.exists(p) else []
    done = [n.getName() for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS"))]
    return sorted((int(n.removeprefix("batch=")) for n in done if n.startswith("batch=")), reverse=True)


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def _remove_mounts(spark: SparkSession, path: str, batch: int, mounts: set[str]) -> None:
    """Removes mounts' folders of a batch, and the batch's own if that was all."""
    fs, p = file_system(spark, f"{path}/data/batch={batch}")
    folders = [x.getPath() for x in fs.listStatus(p) if x.isDirectory()] if fs.exists(p) else []
    gone = [f for f in folders if unquote(f.getName().removeprefix("mount_path=")) in mounts]
    for f in gone:
        fs.delete(f, True)
    if len(gone) == len(folders):
        fs.delete(p, True)


def _rows(spark: SparkSession, path: str, live: list) -> DataFrame:
    """The rows of live mounts: their batches' folders alone are listed, their mounts' alone read."""
    batches = sorted({x.batch for x in live})
    stored = spark.read.option("basePath", f"{path}/data").schema(spark.read.parquet(f"{path}/schema").schema).parquet(*[f"{path}/data/batch={b}" for b in batches])
    some = [(F.col("batch") == b) & F.col("mount_path").isin([x.mount_path for x in live if x.batch == b]) for b in batches]
    return stored.where(reduce(lambda a, b: a | b, some)).drop("batch")


def read_ingested(spark: SparkSession, path: str) -> DataFrame:
    """The table as the newest list has it; its files stay in place for the time of grace. Empty if nothing is live."""
    lists = _lists(spark, path)
    if not lists:
        raise ValueError(f"nothing was published in {path}")
    live = spark.read.parquet(f"{path}/live/batch={lists[0]}").where("gone_at IS NULL").collect()  # a row per mount
    return _rows(spark, path, live) if live else spark.read.parquet(f"{path}/schema").drop("batch")


def ingest(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, grace: int = GRACE) -> StreamingQuery:
    """Keeps every mount's newest version from files that arrive in any number of batches; see read_ingested.

    partial: rows of a batch to sums with mount_path and version. merge: such sums without version, of two batches
    too, to sums of the same columns, whatever the order. Rows of a version that is older than a mount's live one are
    left out, those of a later one replace it, those of the same one are merged with it. Rows without mount_path or
    version are left out. A batch that is repeated after it was published changes nothing. A path belongs to one
    checkpoint; another is an error. Superseded folders go `grace` seconds later, with a batch."""
    spark = stream.sparkSession
    sums = partial(stream).schema
    version = sums["version"].dataType
    kept = T.StructType([f for f in sums if f.name not in ("version", "mount_path")] + [T.StructField("batch", T.LongType()), sums["mount_path"]])
    pointer = T.StructType([T.StructField("mount_path", T.StringType()), T.StructField("version", version), T.StructField("batch", T.LongType()), T.StructField("gone_at", T.LongType()), T.StructField("checkpoint", T.StringType())])
    spark.createDataFrame([], kept).write.mode("ignore").parquet(f"{path}/schema")
    lists = _lists(spark, path)
    owner = spark.read.schema(pointer).parquet(f"{path}/live/batch={lists[0]}").first() if lists else None
    if owner and owner.checkpoint != checkpoint:
        raise ValueError(f"{path} belongs to the checkpoint {owner.checkpoint}")

    def batch(rows: DataFrame, i: int) -> None:
        spark = rows.sparkSession
        lists = _lists(spark, path)
        if lists and lists[0] >= i:
            return
        known = spark.read.schema(pointer).parquet(f"{path}/live/batch={lists[0]}").collect() if lists else []  # a row per mount, and those in grace
        live = {x.mount_path: x for x in known if x.gone_at is None}
        partial(rows).where("mount_path IS NOT NULL AND version IS NOT NULL").write.mode("overwrite").parquet(f"{path}/parts/batch={i}")
        part = spark.read.schema(sums).parquet(f"{path}/parts/batch={i}")
        newest = {x.mount_path: x.version for x in part.groupBy("mount_path").agg(F.max("version").alias("version")).collect()}  # a row per mount
        taken = {m: v for m, v in newest.items() if m not in live or v >= live[m].version}
        same = [live[m] for m, v in taken.items() if m in live and v == live[m].version]
        if taken:
            names = spark.createDataFrame(list(taken.items()), T.StructType([T.StructField("mount_path", T.StringType()), T.StructField("version", version)]))
            own = part.join(names, ["mount_path", "version"], "left_semi").drop("version")
            merged = merge(own.unionByName(_rows(spark, path, same)) if same else own)
            merged = merged.select(*[F.col(f.name).cast(f.dataType) for f in kept if f.name != "batch"])
            merged.hint("rebalance", "mount_path").write.mode("overwrite").partitionBy("mount_path").parquet(f"{path}/data/batch={i}")
        now = int(time.time())
        gone = [x for x in known if x.gone_at is not None]
        for b in {x.batch for x in gone if x.gone_at <= now - grace}:
            _remove_mounts(spark, path, b, {x.mount_path for x in gone if x.batch == b and x.gone_at <= now - grace})
        told = [tuple(x) for m, x in live.items() if m not in taken] + [tuple(x) for x in gone if x.gone_at > now - grace]
        told += [(m, live[m].version, live[m].batch, now, checkpoint) for m in taken if m in live] + [(m, v, i, None, checkpoint) for m, v in taken.items()]
        spark.createDataFrame(told, pointer).coalesce(1).write.mode("overwrite").parquet(f"{path}/live/batch={i}")
        _remove(spark, f"{path}/parts/batch={i}")
        for old in lists[LISTS - 1 :]:
            _remove(spark, f"{path}/live/batch={old}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
