"""Benchmark decontamination: a BM25 index of test items with block-max WAND; passages are the queries.

Each document is cut into overlapping passages that hold any item whole. An item's score for a passage is BM25 over the
passage's distinct words, as a share of the score the item gets from its own words, so one threshold suits all items.
1. Postings hold impact shares. Items are cut into at most GROUPS runs; a word's largest share in each run bounds what
   any item of it can get, so all passages are held against all runs in one array operation, and only those that some
   run could lift to the threshold are searched.
2. Block-max WAND retrieves every item at or above the threshold for these passages; nothing is cut at a top k.
3. A hit stands if the passage holds enough of the item's question (word trigrams) and of its answer (word pairs).

The answer is an item's last sentence or line, or the last third of its words if it is one sentence.
Document frequencies and lengths are counted over all items; the index is broadcast in shards of at most
SHARD_POSTINGS postings, as many at once as have PASS_BYTES; a larger benchmark takes more passes. Documents aren't shuffled.

Nulls: documents and items without words (null texts too) hit nothing; a null doc_id or item_id is carried through.
Repeated documents give repeated rows; repeated items (same id and text) count once. Of equal scores of an item's
passages any is told, they are the same. Very long texts are cut into passages, whole. Empty tables give no rows; other
columns are not read, or pass through unchanged.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import Words, pieces, rolling, stored

K1, B, SHARD_POSTINGS, PASS_BYTES, BLOCK = 1.2, 0.75, 40_000, 64 << 20, 32
GROUPS, RUN = 512, 2
THRESHOLD, QUESTION, ANSWER = 0.5, 0.5, 0.5

_ENDS = re.compile(r"(?<=[.!?])\s+|\n+")


def split_item(text: str) -> tuple[str, str]:
    """(question, answer) of an item."""
    parts = [p for p in _ENDS.split(text.strip()) if re.search(r"\w", p)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = max(1, len(words) - max(1, len(words) // 3))
    return " ".join(words[:cut]), " ".join(words[cut:])


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    return np.unique(rolling(hashes, min(k, len(hashes)))) if len(hashes) else np.zeros(0, np.uint64)


def plain_words(column: pa.Array) -> Words:
    """Words of letters and digits: other ASCII signs part them."""
    return Words(column, parting=common.SIGNS)


@dataclass
class Index:
    """Postings by term, items ascending; impact shares, their maxima by block of BLOCK postings."""

    ids: list
    terms: np.ndarray
    start: np.ndarray
    items: np.ndarray
    share: np.ndarray
    bound: np.ndarray
    block_start: np.ndarray
    block_max: np.ndarray
    run_bound: np.ndarray
    question: list[tuple[np.ndarray, int]]
    answer: list[tuple[np.ndarray, int]]
    longest: int

    def size(self) -> int:
        """Its bytes, more or less; the bounds of the runs are most of it."""
        return self.run_bound.nbytes + 100 * len(self.items)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The term number of each word, -1 if no item has it."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def wand(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Every item whose share from these distinct terms is at least the threshold."""
        low = threshold - 1e-9
        cursors = [[int(self.items[a]), int(t), int(a)] for t, a in zip(terms, self.start[terms], strict=True)]
        found = []

        def skip(c: list, item: int) -> bool:
            """To the first posting at or after item; False at the list's end."""
            end = int(self.start[c[1] + 1])
            c[2] += int(np.searchsorted(self.items[c[2] : end], item))
            if c[2] < end:
                c[0] = int(self.items[c[2]])
            return c[2] < end

        def block(c: list) -> int:
            return int(self.block_start[c[1]]) + (c[2] - int(self.start[c[1]])) // BLOCK

        while cursors:
            cursors.sort()
            total, p = 0.0, -1
            for i, c in enumerate(cursors):
                total += self.bound[c[1]]
                if total >= low:
                    p = i
                    break
            if p < 0:
                break
            pivot = cursors[p][0]
            while p + 1 < len(cursors) and cursors[p + 1][0] == pivot:
                p += 1
            for c in cursors[:p]:
                if c[0] < pivot and not skip(c, pivot):
                    c[0] = -1
            here = [c for c in cursors[: p + 1] if c[0] == pivot]
            if sum(self.block_max[block(c)] for c in here) >= low:
                score = float(sum(self.share[c[2]] for c in here))
                if score >= low:
                    found.append((pivot, score))
                after = pivot + 1
            else:  # no item up to the end of the first of these blocks can reach the threshold
                ends = [min(int(self.start[c[1]]) + ((c[2] - int(self.start[c[1]])) // BLOCK + 1) * BLOCK, int(self.start[c[1] + 1])) - 1 for c in here]
                after = min(int(self.items[e]) for e in ends) + 1
                after = min([after, *(c[0] for c in cursors if c[0] > pivot)])
            cursors = [c for c in cursors if c[0] >= 0 and (c[0] > pivot or skip(c, after))]
        return found

    def holds(self, item: int, hashes: np.ndarray) -> tuple[float, float]:
        """The shares of the item's question and answer that these words hold."""
        out = []
        for grams, k in (self.question[item], self.answer[item]):
            own = rolling(hashes, k) if k else hashes[:0]
            out.append(float(np.isin(grams, own).mean()) if len(grams) else 1.0)
        return out[0], out[1]


def build_index(items: list[tuple[int, str]], idf: dict[int, float], mean_length: float) -> Index:
    """The index of one shard; idf and the mean length are those of the whole benchmark."""
    words = plain_words(pa.array([t for _, t in items], pa.string()))
    rows: list[tuple[int, int, float]] = []
    longest, question, answer = 1, [], []
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        own, tf = np.unique(words.hashes[a:b], return_counts=True)
        longest = max(longest, b - a)
        impact = np.array([idf[int(h)] for h in own]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (b - a) / mean_length))
        rows += [(int(h), i, float(s)) for h, s in zip(own, impact / impact.sum(), strict=True)]
        q, an = (plain_words(pa.array([part], pa.string())).hashes for part in split_item(items[i][1]))
        question.append((_grams(q, 3), min(3, len(q))))
        answer.append((_grams(an, 2), min(2, len(an))))
    rows.sort()
    terms, start = np.unique(np.array([r[0] for r in rows], np.uint64), return_index=True)
    start = np.append(start, len(rows)).astype(np.int64)
    share = np.array([r[2] for r in rows])
    bound = np.maximum.reduceat(share, start[:-1])
    blocks = -(-np.diff(start) // BLOCK)
    block_start = np.concatenate([[0], np.cumsum(blocks)])
    edges = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(start[:-1], start[1:], strict=True)])
    item_of = np.array([r[1] for r in rows], np.int64)
    groups = min(GROUPS, -(-len(items) // RUN))
    run_bound = np.zeros((len(terms), groups), np.float32)
    np.maximum.at(run_bound, (np.repeat(np.arange(len(terms)), np.diff(start)), item_of * groups // len(items)), share.astype(np.float32))
    return Index([i for i, _ in items], terms, start, item_of, share, bound, block_start, np.maximum.reduceat(share, edges), run_bound, question, answer, longest)


def find_in_texts(index: Index, column: pa.Array, threshold: float) -> list[list[tuple[int, float, float, float]]]:
    """Per text its verified hits: item number, score, question and answer share; the best passage of each item."""
    words = plain_words(column)
    out: list[list] = [[] for _ in range(len(column))]
    term = index.lookup(words.hashes)
    known = np.flatnonzero(term >= 0)
    if not len(known):
        return out
    half = max(32, index.longest)
    # passages are numbered over all texts; each but a text's last overlaps the next by half
    first = np.concatenate([[0], np.cumsum(-(-words.counts() // half))])
    doc = np.searchsorted(words.first, known, side="right") - 1
    place = (known - words.first[doc]) // half
    own = first[doc] + place
    again = place > 0
    n = len(index.terms)
    key = np.unique(np.concatenate([own, own[again] - 1]) * n + np.concatenate([term[known], term[known[again]]]))
    passage, key = key // n, key % n
    start = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    reach = np.add.reduceat(index.run_bound[key], start, axis=0).max(axis=1)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for p in passage[start[reach >= threshold - 1e-4]].tolist():
        d = int(np.searchsorted(first, p, side="right")) - 1
        a = int(words.first[d]) + (p - int(first[d])) * half
        b = min(a + 2 * half, int(words.first[d + 1]))
        own = np.unique(term[a:b])
        for item, score in index.wand(own[own >= 0], threshold):
            q, an = index.holds(item, words.hashes[a:b])
            if q >= QUESTION and an >= ANSWER:
                best[d, item] = max(best.get((d, item), (0, 0, 0)), (score, q, an))
    for (d, item), told in sorted(best.items()):
        out[d].append((item, *told))
    return out


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(len(a) > 0, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    return a[new], b[new]


def indexes(benchmark: DataFrame, id_col: str = "item_id") -> Iterator[Index]:
    """The shards' indexes, one after the other."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = plain_words(batch.column(1))
            item = np.repeat(np.arange(batch.num_rows), words.counts())
            pairs = _distinct(item, words.hashes)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64)), pa.array(np.ones(len(pairs[1]), np.int64))], ["term", "n"])

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(plain_words(batch.column(1)).counts())], ["item_id", "text", "n"])

    sized = items.mapInArrow(size, "item_id long, text string, n long").where("n > 0").persist()
    n, total = sized.agg(F.count("*"), F.sum("n")).first()
    shards = -(-(total or 0) // SHARD_POSTINGS)
    frequency = items.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    for k in range(shards):
        own = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).orderBy("item_id", "text").collect()
        if not own:
            continue
        if shards == 1:
            kept = frequency.collect()
        else:  # of the terms, those of this shard alone
            here = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).select("item_id", "text").mapInArrow(count, "term long, n long").select("term").distinct()
            kept = frequency.join(here, "term").collect()
        df = {r.term % (1 << 64): r.df for r in kept}
        yield build_index([(r.item_id, r.text) for r in own], {h: math.log(1 + (n - f + 0.5) / (f + 0.5)) for h, f in df.items()}, total / n)
    sized.unpersist()


def _passes(benchmark: DataFrame) -> Iterator[list[Index]]:
    """The shards' indexes, as many at a time as have PASS_BYTES; one at least."""
    held: list[Index] = []
    for index in indexes(benchmark):
        if held and sum(x.size() for x in (*held, index)) > PASS_BYTES:
            yield held
            held = []
        held.append(index)
    if held:
        yield held


def find_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every verified hit, once per document and item."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for held in _passes(benchmark):
        shared = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text"):
                ids = batch.column(0).to_pylist()
                rows = [(i, index.ids[item], *told) for index in shared.value for i, own in zip(ids, find_in_texts(index, batch.column(1), threshold), strict=True) for item, *told in own]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.float64()] * 3, strict=True)], [x.split()[0] for x in schema.split(", ")])

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (all columns, whatever their names) in which no item was found; no shuffle."""
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("text", F.col(f"c{[n.lower() for n in names].index('text')}").cast("string"))
    for i, held in enumerate(_passes(benchmark)):
        shared = docs.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text"):
                for index in shared.value:
                    hits = find_in_texts(index, batch.column(batch.num_columns - 1), threshold)
                    batch = batch.filter(pa.array([not h for h in hits], pa.bool_()))
                if batch.num_rows:
                    yield batch

        own = (stored(own) if i else own).mapInArrow(run, own.schema)
    return own.drop("text").toDF(*names)
