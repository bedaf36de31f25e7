"""Masked pseudo-likelihood: a bidirectional window network predicts every word from both sides.

1. Words of the whole corpus are counted; the FREQUENT most frequent are classes of their own, all others fall into
   BUCKETS classes by hash. log p(word) is log p(class) plus, in a bucket, the log of the word's counted share in it,
   so every word of the corpus has a probability of its own.
2. Documents are written once as class ids, a byte or two a word. Counts of up to KNOWN words are looked up while
   that is done; rarer words are written beside the ids and joined with the table of counts.
3. The network: each of the SIDE words to the left and right looks up a row for its place, the rows add up to a hidden
   layer (tanh), a softmax over classes follows. Documents are dealt into shards of about SHARD_WORDS words by a hash of
   their own; a task trains on a shard after the other, from the same weights, on another slice of the positions in each
   of the ROUNDS, all slices in turn, and the shards' weights are averaged, by position counts, in a tree of tasks. So
   all positions are learnt from, the driver sees a bounded number of weight vectors, and what is learnt doesn't depend
   on how Spark deals the rows out.
4. All documents are scored: the sum of their words' conditional log-probabilities, and its mean.

Nulls: a null or empty text has 0 words, log_prob 0 and a null mean; a null doc_id is carried through. Repeated rows
count each time and get equal scores. Very long texts are scored whole. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, pieces, signed, stored

FREQUENT, BUCKETS, SIDE, HIDDEN = 96, 32, 2, 32
KNOWN = 1 << 16
ROUNDS, SLICES, BATCH, LEAST_STEPS, RATE = 8, 8, 2048, 60, 0.01
FAN_IN = 16
SHARD_WORDS, MOST_SHARDS = 1 << 21, 1 << 14


@dataclass
class Vocabulary:
    """Classes of words: hashes of the frequent ones, sorted, and each class's count and number of distinct words."""

    frequent: np.ndarray
    count: np.ndarray
    distinct: np.ndarray
    buckets: int

    @property
    def size(self) -> int:
        return len(self.frequent) + self.buckets

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        rest = len(self.frequent) + (hashes % np.uint64(self.buckets)).astype(np.int64)
        if not len(self.frequent):
            return rest
        at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
        return np.where(self.frequent[at] == hashes, at, rest)


def counted(texts: DataFrame) -> DataFrame:
    """(word, n): hashes and counts of the words of all documents (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 8 << 20):
            words, n = np.unique(Words(batch.column(1)).hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(words)), pa.array(n)], ["word", "n"])

    return stored(texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))


def vocabulary(texts: DataFrame, frequent: int = FREQUENT, buckets: int = BUCKETS, counts: DataFrame | None = None) -> Vocabulary:
    """Classes by the counts over all documents (doc_id, text)."""
    counts = counted(texts) if counts is None else counts
    top = counts.orderBy(F.desc("n"), "word").limit(frequent).toPandas()
    hashes = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    # word % buckets as unsigned: buckets is a power of two
    rest = counts.groupBy(F.col("word").bitwiseAND(F.lit(buckets - 1)).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("d")).toPandas()
    out = Vocabulary(hashes[order], np.ones(len(order) + buckets), np.ones(len(order) + buckets), buckets)
    out.count[: len(order)] = top["n"].to_numpy()[order]
    for b, n, d in rest.itertuples(index=False):
        own = (hashes % np.uint64(buckets)) == np.uint64(b)
        out.count[len(order) + int(b)] = max(0.5, n - top["n"].to_numpy()[own].sum())
        out.distinct[len(order) + int(b)] = max(1, d - own.sum())
    return out


def known_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and log counts of at most `most` words, all that are counted as often as some least count."""
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()
    least, words = None, 0
    for x in levels:
        words += x.words
        if words > most:
            break
        least = x.level
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0)
    got = counts.where(level >= least).toPandas()
    hashes = got["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.log(got["n"].to_numpy(np.float64)[order])


class Network:
    """logits = tanh(sum over places of place[s][id]) @ out + bias; the id after the last class stands for an edge."""

    def __init__(self, classes: int, hidden: int = HIDDEN, side: int = SIDE, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.shapes = [(2 * side, classes + 1, hidden), (hidden, classes), (classes,)]
        self.side, self.classes = side, classes
        sizes = [int(np.prod(s)) for s in self.shapes]
        self.flat = np.concatenate([rng.normal(0, 0.3, sizes[0]), rng.normal(0, 0.1, sizes[1]), np.zeros(sizes[2])]).astype(np.float32)

    def parts(self, flat: np.ndarray | None = None) -> list[np.ndarray]:
        flat, out, at = self.flat if flat is None else flat, [], 0
        for s in self.shapes:
            n = int(np.prod(s))
            out.append(flat[at : at + n].reshape(s))
            at += n
        return out

    def contexts(self, ids: np.ndarray, first: np.ndarray, pick: np.ndarray | None = None) -> np.ndarray:
        """(words, 2 * side) ids of the words around each word (or those of `pick`) of its document; `first` as in Words."""
        pick = np.arange(len(ids)) if pick is None else pick
        out = np.full((len(pick), 2 * self.side), self.classes, np.int64)
        doc = np.searchsorted(first, pick, side="right") - 1
        for s, step in enumerate([*range(-self.side, 0), *range(1, self.side + 1)]):
            at = pick + step
            ok = (at >= first[doc]) & (at < first[doc + 1])
            out[ok, s] = ids[at[ok]]
        return out

    def _hidden(self, ctx: np.ndarray) -> np.ndarray:
        place = self.parts()[0]
        h = place[0][ctx[:, 0]]
        for s in range(1, ctx.shape[1]):
            h += place[s][ctx[:, s]]
        return np.tanh(h)

    def log_probs(self, ctx: np.ndarray, ids: np.ndarray, step: int = 4096) -> np.ndarray:
        """log p(class) of each word."""
        _, out, bias = self.parts()
        got = np.empty(len(ids), np.float64)
        for a in range(0, len(ids), step):
            z = self._hidden(ctx[a : a + step]) @ out + bias
            z -= z.max(axis=1, keepdims=True)
            own = z[np.arange(len(z)), ids[a : a + step]].copy()
            got[a : a + step] = own - np.log(np.exp(z, out=z).sum(axis=1))
        return got

    def gradient(self, ctx: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of the mean negative log-probability."""
        place, out, bias = self.parts()
        h = self._hidden(ctx)
        z = h @ out + bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(ids)), ids] -= 1
        p /= len(ids)
        dh = (p @ out.T) * (1 - h * h)
        grad = np.zeros_like(self.flat)
        g_place, g_out, g_bias = self.parts(grad)
        g_out += h.T @ p
        g_bias += p.sum(axis=0)
        for s in range(ctx.shape[1]):
            order = np.argsort(ctx[:, s], kind="stable")
            near = ctx[order, s]
            first = np.flatnonzero(np.diff(near, prepend=-1))
            g_place[s][near[first]] = np.add.reduceat(dh[order], first, axis=0)
        return grad


class Trainer:
    """Adam over batches of positions."""

    def __init__(self, net: Network):
        self.net, self.m, self.v, self.steps, self.seen = net, np.zeros_like(net.flat), np.zeros_like(net.flat), 0, 0

    def step(self, ctx: np.ndarray, ids: np.ndarray) -> None:
        g = self.net.gradient(ctx, ids)
        self.steps += 1
        self.seen += len(ids)
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        self.net.flat -= RATE * (self.m / (1 - 0.9**self.steps)) / (np.sqrt(self.v / (1 - 0.99**self.steps)) + 1e-8)


def _encoded(texts: DataFrame, vocab: Vocabulary, known: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, ids, key, at, inside, rare): a document's classes, a number of its own, a hash of it, the logs of the shares that its words
    have in their buckets summed up as far as counts are known, and the words whose log counts are still to be added."""
    kind = np.uint8 if vocab.size <= 256 else np.uint16
    shared = texts.sparkSession.sparkContext.broadcast((vocab, *known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (vocab, hashes, logs), key = shared.value, TaskContext.get().partitionId() << 40
        total = np.log(vocab.count)
        for batch in pieces(batches, "text"):
            words = Words(batch.column(1))
            ids = vocab.ids(words.hashes)
            rest = np.flatnonzero(ids >= len(vocab.frequent))
            inside, own = np.zeros(len(ids)), words.hashes[rest]
            inside[rest] -= total[ids[rest]]
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                found = hashes[at] == own
                inside[rest[found]] += logs[at[found]]
                rest, own = rest[~found], own[~found]
            sums = np.append(0.0, np.cumsum(inside))[words.first]
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(rest, words.first), pa.int32()), pa.array(signed(own)))
            ids, n = ids.astype(kind), batch.num_rows
            coded = [ids[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coded, pa.binary()), pa.array(np.arange(key, key + n)), batch.column(2), pa.array(np.diff(sums)), rare], ["doc_id", "ids", "key", "at", "inside", "rare"])
            key += n

    own = texts.withColumn("at", F.xxhash64("doc_id", "text"))
    return stored(own.mapInArrow(run, "doc_id long, ids binary, key long, at long, inside double, rare array<long>"))


def _decoded(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    kind = np.uint8 if classes <= 256 else np.uint16
    for batch in pieces(batches, "ids", 1 << 18):
        own = [np.frombuffer(x, kind) for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
        yield batch, np.concatenate(own).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in own])])


_WEIGHTS = "shard int, n long, weights binary"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The means of weight vectors (group, n, weights), weighted by n; a group's rows follow one another."""
    group, n, total = None, 0, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], ["shard", "n", "weights"])

    for batch in batches:
        for g, k, w in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            if g != group and n:
                yield told()
                n = 0
            part = np.frombuffer(w, np.float32).astype(np.float64) * k
            total = part if not n else total + part
            group, n = g, n + k
    if n:
        yield told()


class _Learner:
    """A shard's own copy of the weights in one round, and what it has seen."""

    def __init__(self, shard: int, net: Network, r: int):
        self.shard, self.slice, self.net = shard, r % SLICES, Network(net.classes)
        self.net.flat = net.flat.copy()
        self.trainer, self.first = Trainer(self.net), []
        self.held = [np.zeros((0, 2 * net.side), np.int64), np.zeros(0, np.int64)]

    def learn(self, ids: np.ndarray, at: np.ndarray) -> None:
        pick = np.flatnonzero((np.arange(len(ids)) - np.repeat(at[:-1], np.diff(at))) % SLICES == self.slice)
        ctx, ids = (np.concatenate(x) for x in zip(self.held, (self.net.contexts(ids, at, pick), ids[pick]), strict=True))
        whole = len(ids) // BATCH * BATCH
        for i in range(0, whole, BATCH):
            if len(self.first) < LEAST_STEPS:
                self.first.append((ctx[i : i + BATCH], ids[i : i + BATCH]))
            self.trainer.step(ctx[i : i + BATCH], ids[i : i + BATCH])
        self.held = [ctx[whole:], ids[whole:]]

    def told(self) -> Iterator[pa.RecordBatch]:
        """The shard's weights, once all of it is seen; a small shard is gone over again."""
        if len(self.held[1]):
            self.first.append(tuple(self.held))
            self.trainer.step(*self.held)
        seen = self.trainer.seen
        for i in range(LEAST_STEPS - self.trainer.steps if self.first else 0):
            self.trainer.step(*self.first[i % len(self.first)])
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([self.shard], pa.int32()), pa.array([seen], pa.int64()), pa.array([self.net.flat.tobytes()], pa.binary())], ["shard", "n", "weights"])


def train(encoded: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Network:
    """A network trained on the documents (ids, at), each shard on its own, averaged after each round."""
    net, sc = Network(vocab.size), encoded.sparkSession.sparkContext
    net.parts()[2][:] = np.log(vocab.count / vocab.count.sum())
    shards = min(MOST_SHARDS, max(1, round(vocab.count.sum() / SHARD_WORDS)))
    dealt = encoded.select(F.pmod("at", F.lit(shards)).cast("int").alias("shard"), "at", "ids")
    for r in range(rounds):
        shared = sc.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, r=r) -> Iterator[pa.RecordBatch]:
            learner = None
            for batch in batches:
                shard = batch.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
                for a, b in zip(edges, edges[1:], strict=False):
                    if b > a and (learner is None or learner.shard != shard[a]):
                        if learner:
                            yield from learner.told()
                        learner = _Learner(int(shard[a]), shared.value, r)
                    for _, ids, at in _decoded(iter([batch.slice(a, b - a)]), vocab.size):
                        learner.learn(ids, at)
            if learner:
                yield from learner.told()

        got, k = stored(dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "at", "ids").mapInArrow(run, _WEIGHTS)), shards
        while k > FAN_IN:
            k = -(-k // FAN_IN)
            group = (F.col("shard") / FAN_IN).cast("int").alias("shard")
            got = stored(got.select(group, "n", "weights").repartitionById(k, "shard").sortWithinPartitions("shard", "n", "weights").mapInArrow(_summed, _WEIGHTS))
        rows = sorted(got.collect())
        if rows:
            total = sum(x.n for x in rows)
            net = Network(vocab.size)
            net.flat = (sum(np.frombuffer(x.weights, np.float32).astype(np.float64) * x.n for x in rows) / total).astype(np.float32)
    return net


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob) of each row of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = counted(texts)
    vocab = vocabulary(texts, counts=counts)
    encoded = _encoded(texts, vocab, known_words(counts, KNOWN))
    shared = docs.sparkSession.sparkContext.broadcast(train(encoded, vocab, rounds))
    schema = "doc_id long, key long, n_words long, log_prob double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch, ids, first in _decoded(batches, net.classes):
            got = np.append(0.0, np.cumsum(net.log_probs(net.contexts(ids, first), ids)))[first]
            total = np.diff(got) + batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(first)), pa.array(total)], [x.split()[0] for x in schema.split(", ")])

    rare = encoded.select("key", F.explode("rare").alias("word")).join(counts, "word").groupBy("key").agg(F.sum(F.log("n")).alias("more"))
    scored = encoded.select("doc_id", "ids", "key", "inside").mapInArrow(run, schema).join(stored(rare), "key", "left")
    total = F.least(F.col("log_prob") + F.coalesce("more", F.lit(0.0)), F.lit(0.0))
    return scored.select("doc_id", "n_words", total.alias("log_prob"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_prob"))
