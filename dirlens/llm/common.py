"""Helpers that the training-data operators share: tables in the shared folder,
Arrow batches of bounded size, vectorised word hashes, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a folder of our own only where that is unset, in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What make() gives, kept by this Python worker for its next tasks. A worker keeps one thing at a time: whatever
    it kept under another key goes first, so stages that follow each other in a session don't add up their caches."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts in `column` have about `limit` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // limit
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SIGNS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])  # all ASCII but letters and digits
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        step = np.full(max(n, len(have) + len(have) // 8), _BASE if kind == "up" else _INV, np.uint64)
        step[0] = 1
        have = _powers[kind] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a column of texts, A-Z in lower case, as 64-bit hashes.

    hashes, starts, ends (bytes in `data`), first (index of each row's first word, and the total at the end)."""

    def __init__(self, column: pa.Array, lower: bool = True, parting: np.ndarray = _SPACE):
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        values = column.buffers()[2]
        raw = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
        lo, hi = int(offsets[0]), int(offsets[-1])
        self.data, self.offsets = raw[lo:hi], offsets - lo
        data = _LOWER[self.data] if lower else self.data
        n = len(data)
        word = ~parting[data]
        starts = word.copy()
        starts[1:] &= ~word[:-1]
        edge = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        starts[edge] = word[edge]
        ends = np.zeros(n + 1, bool)
        ends[n] = n > 0 and word[-1]
        ends[1:n] = word[:-1] & (~word[1:] | starts[1:]) if n else False
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * _power("up", n), out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * _power("down", n + 1)[self.starts] + (self.ends - self.starts).astype(np.uint64))
        self.first = np.searchsorted(self.starts, self.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def word_hash(text: str) -> int:
    """The hash that Words gives to one word."""
    return int(Words(pa.array([text.encode()], pa.large_binary())).hashes[0])


_ROLL = [np.uint64(pow(0xD6E8FEB86659FD93, i, 1 << 64) | 1) for i in range(64)]


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes; len(hashes) - k + 1 values."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 8:
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out += hashes[i : i + n] * _ROLL[i]
        return mix(out)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _power("up", len(hashes)), out=total[1:])
    return mix((total[k:] - total[:-k]) * _power("down", n))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over the undirected edges (a, b); longs.

    Min-label propagation with pointer jumping: labels are read from a table in the shared folder in each
    round, so a lost executor costs that round alone. Rounds grow with the logarithm of the longest chain."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    for _ in range(most):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = stored(labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("up")))
        jump = labels.select(F.col("node").alias("up"), F.col("root").alias("far"))
        after = stored(step.join(jump, "up", "left").select("node", "old", F.least("up", F.coalesce("far", "up")).alias("root")))
        labels = after.select("node", "root")
        if after.where("old <> root").isEmpty():
            return labels
    raise RuntimeError(f"components: labels still change after {most} rounds")
