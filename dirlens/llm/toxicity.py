"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

1. A bounded sample of labelled rows (MOST_LABELLED, a parameter) is dealt into two folds by crc32 of doc_id; rows with
   remainder 1 of 3 are held out and never read for learning.
2. Lexicons: words and word beginnings with their toxic log-odds (a lower confidence bound), counted by Spark in each
   fold and in both; at most MOST_UNITS of each.
3. Features in one narrow pass: lexicon densities and peak, nearness of the second person to a lexicon word, capitals,
   punctuation, obfuscation and digit rates, length. Rows of a fold get theirs from the other fold's lexicon.
4. GBTClassifier learns fold 0, IsotonicRegression calibrates on fold 2; all documents are scored with both folds'
   lexicon.

Nulls: a null text is empty and still gets a score; a null doc_id is not held out and its labels aren't used; null
labels are dropped; of several labels of a document the largest counts. Without labels of both kinds every score is the
share of toxic labels (0 without labels). Repeated rows get equal scores. Very long texts are treated whole. An empty
table gives no rows. Other columns are not read, or pass through unchanged.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, pieces

MOST_LABELLED, MOST_UNITS, MOST_MEMO = 12_000, 5_000, 150_000
LIMIT, TASKS = 0.7, 6  # of the score; that the bounded sample is dealt to
STARTS = (4, 5)
FEATURES = ("peak", "density", "hits_rate", "hits", "nearness", "second_person", "capitals", "upper_words", "punctuation", "shouting", "obfuscation", "digits", "length")

# Words that speak to the reader, in the languages at hand, and letters that other signs stand for.
SECOND_PERSON = frozenset("you your yours yourself u ya tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer tú ti tuyo usted ustedes vosotros vuestro".split())
_LEET = str.maketrans("013457@$!|", "oieastasii")

_LETTERS = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_][\d@$!|*#._-]+[^\W\d_]")
_SECOND, _UPPER, _OBFUSCATED = 1 << 10, 1 << 11, 1 << 12  # beside a weight below 1 << 10

_CLASS = np.zeros(256, np.uint8)  # 1 capital, 2 small, 3 digit, 4 shouting, 5 other punctuation
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[33, 63]] = 4
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "!?"]] = 5


def units(token: str) -> tuple[list[str], bool]:
    """The words of a token and their beginnings, as lexicon keys; whether it is written in disguise."""
    core = token.strip(".,;:!?-_*#")
    masked = bool(_MASKED.search(core))
    words = _LETTERS.findall(token.lower())
    if masked:
        words.append(re.sub(r"[^\w]|[\d_]", "", core.lower().translate(_LEET)))
    return [u for w in words for u in (w, *(f"{w[:k]}*" for k in STARTS if len(w) > k)) if w], masked


class _Memo(dict):
    """token -> weight and marks; at most MOST_MEMO tokens at a time, some 45 MB."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> float:
        if len(self) > MOST_MEMO:
            self.clear()
        keys, masked = units(token)
        value = max((self.lexicon.get(u, 0.0) for u in keys), default=0.0)
        value += _SECOND * (not SECOND_PERSON.isdisjoint(keys)) + _UPPER * (len(token) > 2 and token.isupper()) + _OBFUSCATED * masked
        self[token] = value
        return value


def features(text: str, memo: _Memo) -> list[float]:
    tokens = text.split()
    if not tokens:
        return [0.0] * len(FEATURES)
    value = np.fromiter(map(memo.__getitem__, tokens), np.float64, len(tokens))
    marks = value.astype(np.int64)
    weight = value - (marks & ~1023)
    hits, second = np.flatnonzero(weight > 0), np.flatnonzero(marks & _SECOND)
    nearness = 0.0
    if len(hits) and len(second):
        at = np.searchsorted(second, hits)
        gap = np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - hits), np.abs(second[np.maximum(at - 1, 0)] - hits))
        nearness = float(1 / (1 + gap.min()))
    data = np.frombuffer(text.encode(errors="replace"), np.uint8)
    kinds = np.bincount(_CLASS[data], minlength=6)
    n, letters, size = len(tokens), max(1, kinds[1] + kinds[2]), len(data)
    return [float(weight.max()), float(weight.sum() / n), len(hits) / n, float(np.log1p(len(hits))), nearness, len(second) / n, float(kinds[1] / letters), float(np.count_nonzero(marks & _UPPER) / n), float((kinds[4] + kinds[5]) / size), float(kinds[4] / size), float(np.count_nonzero(marks & _OBFUSCATED) / n), float(kinds[3] / size), float(np.log1p(n))]


def remainder(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)), F.lit(0)).cast("int")


def _labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """The sample's (text, fold, toxic), and each label's share."""
    own = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).where("l_id IS NOT NULL AND toxic IN (0, 1)").groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    own = own.withColumn("fold", remainder("l_id")).where("fold <> 1")
    n = own.count()
    kept = own.where(F.pmod(F.xxhash64("l_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, MOST_LABELLED / max(1, n))))
    rows = docs.select(F.col("doc_id").cast("long").alias("l_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    met = rows.join(F.broadcast(kept), "l_id").select("text", "fold", "toxic").repartition(TASKS).persist()
    counts = {r.toxic: r["count"] for r in met.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    return met, {k: v / total for k, v in counts.items()}


def _lexicons(sample: DataFrame) -> dict[str, dict[str, float]]:
    """'0', '2' and 'all': each unit's log-odds of standing in a toxic text, less 1.64 standard errors; over 1 alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text, fold, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.update((u, fold, toxic) for u in {u for t in set(text.split()) for u in units(t)[0]})
        u, fold, toxic = zip(*found, strict=True) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(fold, pa.int32()), pa.array(toxic, pa.int32()), pa.array(found.values(), pa.int64())], ["u", "fold", "toxic", "n"])

    cells = [(f, y) for f in (0, 2) for y in (0, 1)]
    totals = {(r.fold, r.toxic): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}
    seen = sample.mapInArrow(run, "u string, fold int, toxic int, n long").groupBy("u").agg(*[F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == y), F.col("n")).otherwise(0)).alias(f"n{f}{y}") for f, y in cells])
    out = {}
    for name, folds in (("0", [0]), ("2", [2]), ("all", [0, 2])):
        a, b = (sum((F.col(f"n{f}{y}") for f in folds), F.lit(0.5)) for y in (1, 0))
        t1, t0 = (sum(totals.get((f, y), 0) for f in folds) + 1 for y in (1, 0))
        weight = F.log(a / t1) - F.log(b / t0) - 1.64 * F.sqrt(1 / a + 1 / b)
        top = seen.where(a >= 2).select("u", weight.alias("w")).where("w > 1").orderBy(F.desc("w"), "u").limit(MOST_UNITS).collect()
        out[name] = {r.u: min(r.w, 1000.0) for r in top}
    return out


def _scored(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """doc_id as id, the columns `keep` as k0, k1 and so on, and the score of each row."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("id"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample, shares = _labelled(docs, labels)
    if min(shares.get(0, 0), shares.get(1, 0)) == 0:
        return own.drop("text").withColumn("score", F.lit(float(shares.get(1, 0))))
    lexicons = spark.sparkContext.broadcast(_lexicons(sample))
    fit = uuid.uuid4().hex
    schema = "features array<double>"

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = {0: _Memo(lexicons.value["2"]), 2: _Memo(lexicons.value["0"])}
        for batch in batches:
            rows = [features(t, memos[f]) for t, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["features", "fold", "label"])

    rows = sample.mapInArrow(learn, f"{schema}, fold int, label int").select(array_to_vector("features").alias("features"), "fold", F.col("label").cast("double").alias("label"))
    rows = rows.repartition(TASKS, "label", "features").persist()
    folds = {(r.fold, r.label) for r in rows.select("fold", "label").distinct().collect()}
    one = 0 if {(0, 0.0), (0, 1.0)} <= folds else 2
    trees = GBTClassifier(maxIter=25, maxDepth=3, stepSize=0.2, seed=7, maxBins=64).fit(rows.where(F.col("fold") == one) if (one, 0.0) in folds and (one, 1.0) in folds else rows)
    other = rows.where(F.col("fold") != one) if len({x for x in folds if x[0] != one}) == 2 else rows
    proba = vector_to_array("probability").getItem(1)
    curve = IsotonicRegression(featuresCol="p", predictionCol="calibrated").fit(trees.transform(other).select(proba.alias("p"), "label"))
    sample.unpersist()
    rows.unpersist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = kept(("toxicity", fit), lambda: _Memo(lexicons.value["all"]))
        for batch in pieces(batches, "text"):
            rows = [features(t, memo) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "features"])

    kinds = ", ".join(f"{c} {t}" for c, t in own.dtypes[:-1])
    seen = own.mapInArrow(run, f"{kinds}, {schema}").withColumn("features", array_to_vector("features"))
    scored = curve.transform(trees.transform(seen).withColumn("p", proba))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("calibrated") * 0.999 + F.col("p") * 0.001)).alias("score")
    return scored.select(*own.columns[:-1], score)


def _predicted() -> Column:
    return (F.col("score") >= LIMIT).cast("int")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs."""
    return _scored(docs, labels, []).select(F.col("id").alias("doc_id"), remainder("id").eqNullSafe(F.lit(1)).alias("held_out"), "score", _predicted().alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs (all columns, whatever their names) that are not predicted toxic."""
    names = docs.columns
    return _scored(docs, labels, names).where(_predicted() == 0).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])
