"""Nearest neighbours by learned partitions.

1. On a bounded sample (SAMPLE vectors, chosen by a hash of vec_id) a neighbour graph is built and cut into partitions
   of nearly equal size: nodes move to the partition most of their neighbours are in while it has room. There are about
   sqrt(rows) / 4 partitions, as far as the sample has 2 * GRAPH vectors for each; a table of fewer has one.
2. A softmax classifier learns, from each sampled vector, the partitions its neighbours lie in. It gives every vector
   of the table its home; a query goes to its most probable partitions, as many as the sample needs for TARGET recall.
3. Partitions are split into blocks of BLOCK candidates and of QUERIES queries, so none has to fit in a task; each pair
   of blocks is multiplied in one task, and the best are scored again exactly and merged.

Of equal vectors only the k + 1 smallest ids can be among the k nearest, so no others are carried as candidates; all
stay queries. Distances are not cut otherwise: what isn't found lies in a partition that was not probed.

Nulls: rows with a null vec_id, and vectors that are null, zero, of another length than most, or that hold null or
non-finite components, take no part. Rows with the query's vec_id are not its candidates; of rows that share a vec_id
the one whose vector's bytes come first counts. Ties go to the smaller vec_id. An empty table gives no rows, and a query fewer than k rows if there are fewer candidates. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLE, GRAPH, TARGET, BLOCK, QUERIES, STEP = 8192, 10, 0.96, 4096, 32_768, 2048


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each unit row."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        near = x[a : a + 1024] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        out[a : a + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_partitions(x: np.ndarray, graph: np.ndarray, parts: int, passes: int = 12, slack: float = 1.1) -> np.ndarray:
    """A partition of each node; none has more than slack times its share."""
    rng, n = np.random.default_rng(5), len(x)
    room = int(np.ceil(slack * n / parts))
    centres = x[rng.choice(n, parts, replace=False)]
    near = x @ centres.T
    home, size = np.full(n, -1), np.zeros(parts, np.int64)
    for i in np.argsort(-near.max(axis=1), kind="stable"):
        p = next(p for p in np.argsort(-near[i], kind="stable") if size[p] < room)
        home[i], size[p] = p, size[p] + 1
    both = [set(g) for g in graph.tolist()]
    for i, g in enumerate(graph.tolist()):
        for j in g:
            both[j].add(i)
    for _ in range(passes):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(home[list(both[i])], minlength=parts)
            votes[(size >= room) & (np.arange(parts) != home[i])] = -1
            p = int(votes.argmax())
            if votes[p] > votes[home[i]]:
                size[home[i]] -= 1
                size[p] += 1
                home[i] = p
                moved += 1
        if not moved:
            break
    return home


@dataclass
class Router:
    """A softmax over partitions, and how many of them a query probes."""

    weights: np.ndarray
    bias: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return _unit(x) @ self.weights + self.bias

    def ranked(self, x: np.ndarray, m: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :m].astype(np.int32)


def train_router(x: np.ndarray, parts: int, k: int = 5, steps: int = 400) -> Router:
    """From the sample alone."""
    x, d = _unit(x), x.shape[1]
    parts = max(1, min(parts, len(x) // (2 * GRAPH)))
    router = Router(np.zeros((d, parts)), np.zeros(parts), parts)
    if parts == 1:
        return router
    graph = neighbour_graph(x, GRAPH)
    home = balanced_partitions(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), GRAPH), home[graph].ravel()), 1 / GRAPH)
    target[np.arange(len(x)), home] += 1
    target /= 2
    m, v = [np.zeros_like(router.weights), np.zeros_like(router.bias)], [np.zeros_like(router.weights), np.zeros_like(router.bias)]
    for t in range(1, steps + 1):
        z = x @ router.weights + router.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        e = (p - target) / len(x)
        for i, g in enumerate((x.T @ e + 1e-6 * router.weights, e.sum(axis=0))):
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.01 * (g * g - v[i])
            (router.weights, router.bias)[i][...] -= 0.1 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-9)
    ranked = router.ranked(x, parts)
    at = np.empty((len(x), parts), np.int64)
    np.put_along_axis(at, ranked, np.arange(parts)[None, :], axis=1)
    nearest = neighbour_graph(x, min(k, len(x) - 1))
    needed = np.take_along_axis(at, ranked[nearest][:, :, 0], axis=1).ravel()  # the rank of each neighbour's home
    router.probes = min(parts, int(np.quantile(needed, TARGET, method="higher")) + 1)
    return router


def _valid(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    own = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    most = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return own.where(F.size("v") == (most.d if most else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def build_router(vectors: DataFrame, k: int = 5) -> Router | None:
    """A router for the vectors (vec_id, v), trained on a bounded sample of them."""
    n = vectors.count()
    if not n:
        return None
    rows = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / n))).orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * SAMPLE).select("v").toPandas()
    if len(rows) < 2:
        rows = vectors.limit(1).select("v").toPandas()
    return train_router(np.stack(rows["v"].to_numpy()).astype(np.float64), max(2, round(n**0.5 / 4)), k)


def _best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of the candidates for each query; exact cosines, ties to the smaller id."""
    units, m, found = _unit(c).T, min(len(c_ids), k), []
    for a in range(0, len(q), STEP):
        near = _unit(q[a : a + STEP]) @ units
        near[q_ids[a : a + STEP, None] == c_ids[None, :]] = -np.inf
        least = -np.partition(-near, m - 1, axis=1)[:, m - 1]
        at = np.nonzero(near >= least[:, None] - 1e-12)  # all that rounding may put among the k best
        found.append((at[0] + a, at[1]))
    rows, cols = (np.concatenate(x) for x in zip(*found, strict=True))
    ids, score = c_ids[cols], np.empty(len(rows))
    for i in range(0, len(rows), 1 << 14):
        a, b = q[rows[i : i + (1 << 14)]], c[cols[i : i + (1 << 14)]]
        a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
        score[i : i + (1 << 14)] = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    ok = ids != q_ids[rows]
    rows, ids, score = rows[ok], ids[ok], score[ok]
    order = np.lexsort((ids, -score, rows))
    rows, ids, score = rows[order], ids[order], score[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return pd.DataFrame({"query_id": q_ids[rows], "vec_id": ids, "score": score})[rank < k]


def nearest(table: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found to each vector whose id is divisible by query_every."""
    spark = table.sparkSession
    vectors = _valid(table, id_col, vec_col)
    router = build_router(vectors, k)
    if router is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(router)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                ranked = shared.value.ranked(x, shared.value.probes)
                query = batch.column(0).to_numpy() % query_every == 0
                probes = pa.array([r.tolist() if q else None for r, q in zip(ranked, query, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(ranked[:, 0]), probes], ["vec_id", "vec", "home", "probes"])

    routed = stored(vectors.mapInArrow(route, "vec_id long, vec binary, home int, probes array<int>"))
    same = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    once = routed.groupBy("vec_id").agg(F.min(F.struct("vec", "home", "probes")).alias("x")).select("vec_id", "x.*")
    candidates = stored(once.withColumn("copy", same).where(F.col("copy") <= k + 1).select("vec_id", "vec", "home"))
    queries = stored(once.where("probes IS NOT NULL").select("vec_id", "vec", F.explode("probes").alias("home")))

    def blocks(df: DataFrame, size: int) -> DataFrame:
        return df.groupBy("home").agg(F.ceil(F.count("*") / size).cast("int").alias("n"))

    sizes = F.broadcast(blocks(candidates, BLOCK).withColumnRenamed("n", "nc").join(blocks(queries, QUERIES).withColumnRenamed("n", "nq"), "home"))  # a row per partition
    c = candidates.join(sizes, "home").select("home", "vec_id", "vec", F.pmod(F.xxhash64("vec_id"), "nc").cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"))
    q = queries.join(sizes, "home").select("home", "vec_id", "vec", F.pmod(F.xxhash64("vec_id"), "nq").cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("cb"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        x, y = (np.frombuffer(b"".join(s["vec"]), np.float64).reshape(len(s), -1) for s in (left, right))
        return _best(left["vec_id"].to_numpy(), x, right["vec_id"].to_numpy(), y, k)

    key = ["home", "qb", "cb"]
    found = q.groupBy(*key).cogroup(c.toDF(*c.columns).groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
