"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of documents. In each window (a round) every queue is credited its share of `window_tokens`,
in proportion to its tokens (or to given weights), and sends documents while it has credit; what a document takes
beyond the credit, or leaves of it, is carried into the next window. A queue that has run dry gets no more credit, and
the others share what it would have got in proportion to theirs, so windows stay full to the end. Sources of no weight
come after all others, in proportion to their tokens.

The window in which a document leaves follows from its place in its queue alone, so no task has to see the queues in
turn. After v windows' worth of its own credit a queue of share s has sent s * v * window_tokens; it is dry at its own
v_s. By then all queues have sent the sum over them of s * min(v, v_s) windows, which is the window sought: v itself
while none is dry. Places are running totals: within a task's rows, then over (source, task) totals, so one source may
hold any part of all rows. Documents in window order make one stream of tokens, which is cut into sequences; only the
last can need padding.

A document leaves once its queue's credit reaches a point inside it that a hash of the row chooses; sources of one
document each so spread over all windows.

Nulls: a null text is empty (it has the end id alone), a null source is the source ''. A null doc_id is carried
through. Repeated rows are packed once each. Very long texts are cut into many pieces. An empty table gives no pieces.
Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, stored
from .tokens import encoder

SEQUENCE = 2048
ROUNDS_IN_BLOCK = 4096
_QUEUED = "row long, doc_id long, source string, part long, at long, n long, ids binary"


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Per row: its ids with end_id, their number, and how many ids of its source precede it in its task (`at`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], enc.kind).tobytes()
        sent: dict[str, int] = {}
        row = part << 33
        for batch in pieces(batches, "text"):
            ids = [enc.ids(t or "") + end for t in batch.column(2).to_pylist()]
            n = [len(x) // enc.width for x in ids]
            at = []
            for s, k in zip(sources := batch.column(1).to_pylist(), n, strict=True):
                at.append(sent.get(s, 0))
                sent[s] = at[-1] + k
            rows = pa.array(range(row, row + len(n)), pa.int64())
            row += len(n)
            yield pa.RecordBatch.from_arrays(
                [rows, batch.column(0), pa.array(sources, pa.string()), pa.array([part] * len(n), pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                [x.split()[0] for x in _QUEUED.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(run, _QUEUED)


class _Queue(NamedTuple):
    source: str
    tokens: int
    share: float
    dry: float


def _named(tokens: DataFrame, weights: dict[str, float], window_tokens: int) -> list[_Queue]:
    """The sources (source, n_source) of positive weight that there are, with their shares and when they are dry."""
    if any(not 0 <= w < math.inf for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    kept = {s: w for s, w in weights.items() if w > 0}
    found = {r.source: r.n_source for r in tokens.where(F.col("source").isin(list(kept))).collect()} if kept else {}
    whole = sum(kept[s] for s in found)
    return [_Queue(s, n, kept[s] / whole, n / (kept[s] / whole * window_tokens)) for s, n in sorted(found.items())]


def windows(queued: DataFrame, window_tokens: int, weights: dict[str, float] | None = None) -> DataFrame:
    """(row, start_at, window): where each row's ids begin in the packed stream, and the window in which it leaves.

    weights: the sources' shares of each window, in any unit; none means in proportion to their tokens."""
    q = queued.select("row", "source", "part", "at", "n")
    task = q.groupBy("source", "part").agg(F.sum("n").alias("n_task"))
    task = task.withColumn("before", F.sum("n_task").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    total = float(task.agg(F.sum("n_task")).first()[0] or 1)
    tokens = task.groupBy("source").agg(F.sum("n_task").alias("n_source"))
    named = _named(tokens, weights or {}, window_tokens)
    rest = total - sum(x.tokens for x in named)
    share = F.col("n_source") / (rest or 1.0)
    if named:
        table = F.create_map(*[F.lit(x) for q in named for x in (q.source, q.share)])
        share = F.coalesce(F.element_at(table, F.col("source")), share)
    task = stored(task.join(tokens, "source").select("source", "part", F.coalesce("before", F.lit(0)).alias("before"), (share * window_tokens).alias("quantum")))
    point = (F.pmod(F.xxhash64("row"), F.lit(1 << 20)) + 0.5) / (1 << 20)
    placed = q.join(task, ["source", "part"]).withColumn("place", F.col("before") + F.col("at"))
    own = (F.col("place") + F.col("n") * point) / F.col("quantum")
    if named:
        ends = F.array(*[F.struct(F.lit(x.share).alias("share"), F.lit(x.dry).alias("dry")) for x in named])
        mixed = F.aggregate(ends, F.lit(0.0), lambda sent, x: sent + x["share"] * F.least(own, x["dry"]))
        own = F.when(F.col("source").isin([x.source for x in named]), mixed).otherwise(own + float(-(-(total - rest) // window_tokens)))
    placed = stored(placed.select("row", "source", "place", "n", F.floor(own).alias("window")))

    block = F.floor(F.col("window") / ROUNDS_IN_BLOCK)
    sums = stored(placed.groupBy("window").agg(F.sum("n").alias("n_window")).withColumn("block", block))
    blocks = sums.groupBy("block").agg(F.sum("n_window").alias("n_block")).withColumn("earlier", F.sum("n_block").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.sum("n_window").over(Window.partitionBy("block").orderBy("window").rowsBetween(Window.unboundedPreceding, -1))
    begins = sums.withColumn("inside", inside).join(F.broadcast(blocks), "block").select("window", (F.coalesce("inside", F.lit(0)) + F.coalesce("earlier", F.lit(0))).alias("begin"))
    earlier = F.sum("n").over(Window.partitionBy("window").orderBy("source", "place", "row").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("earlier", earlier).join(begins, "window").select("row", "window", (F.col("begin") + F.coalesce("earlier", F.lit(0))).alias("start_at"))


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long"


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, window_tokens: int = 64 * SEQUENCE, weights: dict[str, float] | None = None, keep_ids: bool = False) -> DataFrame:
    """All documents cut into pieces of sequences of at most `sequence` ids; with keep_ids also the pieces' ids."""
    queued = stored(tokenize(docs, tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(tokenizer).kind
        for batch in batches:
            rows, kept = [], []
            for doc, n, ids, at, window in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                wide = np.frombuffer(ids, kind).astype("<u4")
                a = 0
                while a < n:
                    s, o = divmod(at + a, sequence)
                    b = min(n, a + sequence - o)
                    own = wide[a:b].tobytes()
                    rows.append((doc, a, b - a, zlib.crc32(own), n, s, o, window))
                    if keep_ids:
                        kept.append(own)
                    a = b
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            arrays = [pa.array(c, pa.int64()) for c in cols] + ([pa.array(kept, pa.binary())] if keep_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _PIECE.split(", ")] + ["ids"] * keep_ids)

    joined = queued.select("row", "doc_id", "n", "ids").join(windows(queued, window_tokens, weights), "row").select("doc_id", "n", "ids", "start_at", "window")
    return joined.mapInArrow(run, _PIECE + ", ids binary" * keep_ids)
