"""Line dedup by a log-template tree of fixed depth, in DataFrame functions alone.

A line's path in the tree is its number of tokens, then its leading tokens; a token that holds a digit is the field
<*>. The nodes are at the DEPTHS, so a template that shares few leading tokens with others has a node of its own
further down. A node generalises: of the runs of tokens behind the leading ones (CELLS runs a line at most, a token
each up to as many tokens) those that all its lines share are constant, the others are fields. A node of lines of
LEAST_NODE documents, of which at least half the runs are constant, is a template; the masked line itself is one too,
if LEAST_EXACT documents have it (LEAST_NODE, if it has fewer than SHORT tokens).
Of a recurring template the lines of the document with the smallest doc_id stay, all others are dropped.

Templates are 64-bit hashes, carried with their line's place; runs are 32-bit hashes. Partial sums go before each
shuffle; joins read what recurs from a table, so Spark splits a template that many documents have. Lines without a letter (blank ones too) have no exact template.

Nulls: a null text has no lines and stays null. A null doc_id comes after all others. Rows that share the smallest
doc_id all keep their lines; repeated rows are one document and get equal results. Very long texts are treated whole,
and a line may have any length. An empty table gives no rows. Columns other than text pass through unchanged, whatever
their names, but for n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored

DEPTHS, CELLS, LEAST_EXACT, LEAST_NODE, SHORT = (2, 4), 16, 2, 3, 3  # the code below counts two and three documents
_LAST = (1 << 63) - 1

_LINES = r"split(text, '\n', -1)"
_MASKED = r"IF(l RLIKE '[0-9]', regexp_replace(l, r'(?<![^ ])[^ 0-9]*+[0-9][^ ]*+', '<*>'), l)"
#: Keys of a line's masked text m and tokens t. They end in what they are: 0 a masked line, 1 a short one, 2 and 3 nodes.
_EXACT = rf"IF(m RLIKE '\\p{{L}}', shiftleft(xxhash64(m), 2) | IF(n >= {SHORT}, 0L, 1L), NULL)"
_NODES = [f"IF(n > {d}, shiftleft(xxhash64(n, slice(t, 1, {d})), 2) | {i + 2}L, NULL)" for i, d in enumerate(DEPTHS)]
_KEYS = f"array_compact(array({', '.join([_EXACT, *_NODES])}))"


def _cell(i: int) -> str:
    """SQL: the hash of a line's run number i; 0 for fields alone, null beyond the last run."""
    run = f"slice(t, int({i} * n / {CELLS}) + 1, int({i + 1} * n / {CELLS}) - int({i} * n / {CELLS}))"
    return f"CASE WHEN n <= {i} THEN NULL WHEN n <= {CELLS} THEN IF(t[{i}] = '<*>', 0, hash(t[{i}])) WHEN t[int({i} * n / {CELLS})] = '<*>' AND forall({run}, y -> y = '<*>') THEN 0 ELSE hash({run}) END"


_CELLS = f"IF(n > {DEPTHS[0]}, array({', '.join(_cell(i) for i in range(CELLS))}), NULL)"


def _constant(kind: int) -> str:
    """SQL: whether at least half the runs behind the leading tokens are constant, and not fields alone."""
    depth, cells = DEPTHS[kind - 2], f"least({CELLS}, n)"
    behind = f"filter(sequence(0, {cells} - 1), i -> int(i * n / {cells}) >= {depth})"
    same = f"size(filter({behind}, i -> low[i] = high[i] AND low[i] <> 0))"
    return f"size({behind}) > 0 AND 2 * {same} >= size({behind})"


def _gone(docs: DataFrame) -> DataFrame:
    """(d, th, gone): numbers of the lines to drop of documents (doc_id, text) that have any."""
    told = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64("text").alias("th"), F.posexplode(F.expr(_LINES)).alias("pos", "l"))
    told = told.select("d", "th", "pos", F.expr(_MASKED).alias("m")).select("d", "th", "pos", "m", F.expr("split(m, ' ', -1)").alias("t"))
    told = told.select("d", "th", "pos", "m", "t", F.size("t").alias("n"))
    rows = stored(told.select("d", "th", "pos", "n", F.expr(_KEYS).alias("keys"), F.expr(_CELLS).alias("cells")))
    each = rows.select("d", "th", "pos", F.explode("keys").alias("key"))
    kind = F.col("key").bitwiseAND(F.lit(3))

    often = each.groupBy("key").agg(F.min("d").alias("least"), F.max("d").alias("most"))
    met = stored(each.join(stored(often.where("least < most")), "key"))  # two documents at least
    third = stored(met.where((kind > 0) & (F.col("d") > F.col("least")) & (F.col("d") < F.col("most"))).select("key").distinct())
    short = met.where(kind == 1).join(third, "key", "left_semi")
    nodes = met.where(kind > 1).join(third, "key", "left_semi")

    # the lines of the nodes that recur, and what they share
    lines = rows.where("cells IS NOT NULL").select("d", "th", "pos", "n", "cells").join(nodes.select("d", "th", "pos", "key"), ["d", "th", "pos"])
    ends = [f(F.col("cells")[i]).alias(f"{k}{i}") for i in range(CELLS) for k, f in (("low", F.min), ("high", F.max))]
    shared = lines.groupBy("key").agg(F.max("n").alias("n"), *ends).select("key", "n", *[F.array(*[f"{k}{i}" for i in range(CELLS)]).alias(k) for k in ("low", "high")])
    templates = stored(shared.where(F.expr(f"CASE WHEN (key & 3L) = 2 THEN {_constant(2)} ELSE {_constant(3)} END")).select("key"))

    drop = met.where(kind == 0).union(short.select(*met.columns)).union(nodes.join(templates, "key", "left_semi").select(*met.columns)).where("d > least")
    return drop.groupBy("d", "th").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of docs with recurring lines dropped from text, and n_lines and n_dropped of each."""
    docs = docs.drop("n_lines", "n_dropped").withColumn("text", F.col("text").cast("string"))
    d, th, gone = (free_name(docs, x) for x in ("d", "th", "gone"))
    found = stored(_gone(docs.select("doc_id", "text"))).toDF(d, th, gone)
    own = docs.withColumn(d, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn(th, F.xxhash64("text"))
    met = own.join(found, [d, th], "left")
    # the runs of lines between dropped ones: each line is looked at once, however many go
    first = "IF(k = 0, 0, g[k - 1] + 1)"
    runs = f"flatten(transform(sequence(0, size(g)), k -> slice(x, {first} + 1, IF(k = size(g), size(x), g[k]) - {first})))"
    left = f"transform(array(sort_array({gone})), g -> transform(array({_LINES}), x -> {runs})[0])[0]"
    text = F.expr(rf"IF({gone} IS NULL, text, array_join({left}, '\n'))")
    n_lines = F.coalesce(F.expr(f"size({_LINES})"), F.lit(0)).alias("n_lines")
    n_dropped = F.coalesce(F.size(gone), F.lit(0)).alias("n_dropped")
    return met.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], n_lines, n_dropped)
