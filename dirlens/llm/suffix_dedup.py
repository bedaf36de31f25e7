"""Passages of at least MIN_WORDS words that repeat across documents, by sparse suffixes.

A word belongs to a repeated passage if a window of MIN_WORDS words around it stands in another document too.

1. Each window goes with a minimiser: of its word positions the first one with the least hash of the HEAD words there.
   Equal windows have it at the same place. A suffix is a minimiser with its head and its reach, the words of all
   windows that go with it (up to MIN_WORDS - HEAD beside the head on each side).
2. Only suffixes whose head stands in several documents are kept. Where a reach stands in several, all its windows do.
   Every other reach of a head with several is taken apart into its windows, and these are counted, one place for
   each different reach. Counts are least and greatest rows, with partial sums before the shuffle, so that a passage
   which a third of all documents hold is spread like any other.
3. What was found goes back to the documents as a bit per window, and neighbouring windows are merged to spans.
Spans of a document that touch are merged. Words are as in the Jaccard join. Every two documents that share a window
meet in it, whatever others hold its head, and however often it repeats.

Nulls: a null text has no words; a null doc_id is carried through. Rows with equal doc_id and text are one document,
and so don't repeat each other. A passage that repeats within one document alone is left alone. Very long texts are
treated whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, _power, mix, pieces, rolling, signed, stored

MIN_WORDS, HEAD, MAP_BITS = 50, 25, 24
_SUFFIX = "head long, reach long, row long, pos int"
_SPAN = "row long, doc_id long, start long, end long, n_words long"


def minimisers(heads: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least value of each `width` neighbours; of equal values that follow closely, one per width."""
    if len(heads) < width:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(heads, width)
    at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    same = np.append(False, (heads[at[1:]] == heads[at[:-1]]) & (np.diff(at) < width))
    begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
    step = (at - at[begin]) // width
    return at[~same | (step != np.append(0, step[:-1]))]


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return own.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")


def _least(heads: np.ndarray, width: int) -> np.ndarray:
    """For each `width` neighbours the position of the first least value."""
    return np.lib.stride_tricks.sliding_window_view(heads, width).argmin(axis=1) + np.arange(len(heads) - width + 1)


def suffixes(texts: DataFrame, min_words: int = MIN_WORDS, head: int = HEAD) -> DataFrame:
    """(head, reach, row, pos): hashes of a suffix's head and of all words of its windows, and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = Words(batch.column(2))
            n = len(words.hashes)
            every, rows = rolling(words.hashes, head), batch.column(0).to_numpy()
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hashes * _power("up", n), dtype=np.uint64)])
            out: list[list[np.ndarray]] = [[], [], [], []]
            for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                if b - a < min_words:
                    continue
                own = every[a : b - head + 1]
                least = _least(own, min_words - head + 1)
                first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
                end = np.append(first[1:], len(least)) - 1 + min_words
                at = least[first]
                shape = mix(((at - first) * min_words + end - first).astype(np.uint64))
                reach = mix((total[a + end] - total[a + first]) * _power("down", n + 1)[a + first] + shape)
                for c, x in zip(out, (signed(own[at]), signed(reach), np.full(len(at), rows[i]), at.astype(np.int32)), strict=True):
                    c.append(x)
            cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.int32()], strict=True)], ["head", "reach", "row", "pos"])

    return texts.mapInArrow(run, _SUFFIX)


def _with_texts(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (row, ...), one of each, with doc_id and text; a bitmap of fixed size keeps most others from being shuffled."""
    bit = F.pmod("row", F.lit(1 << MAP_BITS))
    words = rows.groupBy(F.floor(bit / 32).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(row, 32) AS int))")).alias("bits")).toPandas()
    bitmap = np.zeros(1 << (MAP_BITS - 5), np.uint32)
    bitmap[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy() % (1 << MAP_BITS)
            yield batch.filter(pa.array((shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1))

    return texts.mapInArrow(run, "row long, doc_id long, text string").join(rows, "row")


def _windows(texts: DataFrame, reaches: DataFrame, min_words: int, head: int) -> DataFrame:
    """(key, reach, off, row, several) of each window of the reaches (reach, row, pos, several): its hash, and how far
    before the minimiser it begins."""
    placed = reaches.groupBy("row").agg(F.collect_list(F.struct("pos", "reach", "several")).alias("at"))
    met = _with_texts(texts, stored(placed)).select("row", "text", F.col("at.pos").alias("pos"), F.col("at.reach").alias("reach"), F.col("at.several").alias("several"))
    schema = "key long, reach long, off int, row long, several int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = Words(batch.column(1))
            every, keys = rolling(words.hashes, head), rolling(words.hashes, min_words)
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, row in enumerate(batch.column(0).to_pylist()):
                a, b = words.first[i], words.first[i + 1]
                pos, reach, several = (np.asarray(batch.column(k)[i].values) for k in (2, 3, 4))
                order = np.argsort(pos)
                pos = pos[order]
                least = _least(every[a : b - head + 1], min_words - head + 1)
                k = np.minimum(np.searchsorted(pos, least), len(pos) - 1)
                s = np.flatnonzero(pos[k] == least)
                k = order[k[s]]
                for c, x in zip(out, (signed(keys[a + s]), reach[k], least[s] - s, np.full(len(s), row), several[k]), strict=True):
                    c.append(x)
            cols = [np.concatenate(c) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()], strict=True)], [x.split()[0] for x in schema.split(", ")])

    return met.mapInArrow(run, schema)


def _spans(texts: DataFrame, found: DataFrame, min_words: int, head: int) -> DataFrame:
    """Merged spans of the windows in found (row, pos, bits): bit o stands for the window that begins o words before pos."""
    placed = found.groupBy("row").agg(F.collect_list(F.struct("pos", "bits")).alias("at"))
    met = _with_texts(texts, stored(placed)).select("row", "doc_id", "text", F.col("at.pos").alias("pos"), F.col("at.bits").alias("bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words, rows = Words(batch.column(2)), []
            every, chars = rolling(words.hashes, head), np.cumsum((words.data & 0xC0) != 0x80)
            for i, (row, doc) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                a, b = words.first[i], words.first[i + 1]
                least = _least(every[a : b - head + 1], min_words - head + 1)
                bits = np.zeros(b - a, np.int64)
                bits[np.asarray(batch.column(3)[i].values)] = np.asarray(batch.column(4)[i].values)
                s = np.flatnonzero((bits[least] >> (least - np.arange(len(least)))) & 1)
                cut = np.flatnonzero(np.diff(s) > min_words)
                base = chars[words.offsets[i] - 1] if words.offsets[i] else 0
                for u, v in zip(s[np.append(0, cut + 1)].tolist(), (s[np.append(cut, len(s) - 1)] + min_words).tolist(), strict=True):
                    rows.append((row, doc, int(chars[words.starts[a + u]] - 1 - base), int(chars[words.ends[a + v - 1] - 1] - base), v - u))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in _SPAN.split(", ")])

    return met.mapInArrow(run, _SPAN)


def find_repeats(docs: DataFrame, min_words: int = MIN_WORDS, head: int = HEAD) -> DataFrame:
    """(doc_id, start, end, n_words): each document's spans, in code points, that stand in other documents too."""
    if min_words - head > 62:
        raise ValueError("at most 62 words beside a head")
    texts = _texts(docs)
    every = stored(suffixes(texts, min_words, head))
    shared = every.groupBy("head").agg(F.min("row").alias("least"), F.max("row").alias("most")).where("least < most")
    kept = stored(every.join(shared.select("head"), "head", "left_semi"))

    reaches = stored(kept.groupBy("head", "reach").agg(F.min(F.struct("row", "pos")).alias("at"), F.max("row").alias("most")).select("head", "reach", "at.row", "at.pos", F.expr("int(most > at.row)").alias("several")))
    mixed = reaches.groupBy("head").agg(F.count("*").alias("n")).where("n > 1").select("head")
    windows = stored(_windows(texts, reaches.join(mixed, "head", "left_semi").drop("head"), min_words, head))
    met = windows.groupBy("key").agg(F.min("row").alias("least"), F.max("row").alias("most"), F.max("several").alias("several")).where("least < most OR several = 1").select("key")
    parts = windows.where("several = 0").join(met, "key", "left_semi").groupBy("reach").agg(F.bit_or(F.expr("shiftleft(1L, off)")).alias("bits"))
    bits = stored(parts.union(reaches.where("several = 1").select("reach", F.lit(-1).cast("long").alias("bits"))))
    found = stored(kept.join(bits, "reach").select("row", "pos", "bits"))
    return _spans(texts, found, min_words, head).distinct().drop("row")
