"""Host-level quality rules, in DataFrame functions alone.

1. Each document is measured (words, symbols, repeated lines and passages) and held against RULES.
2. Failures of each rule are summed up by host. A host's rate of failures is shrunk: the rates of all hosts give a beta
   prior by their moments (mean m, variance beyond that of drawing n documents, hence strength s), and the host's rate
   is (failures + s * m) / (documents + s). Where hosts differ no more than chance would have it, s has no bound and
   every rate is m; s is LEAST_STRENGTH at least, so that a few documents reject no host. Hosts count once each in m,
   so a host of a third of all rows is no more than one host.
3. A host is rejected if its shrunk rate of a rule is above HOST_LIMIT, and its own one too. Its documents go.

A document is kept if it passes the two base rules itself and its host isn't rejected.

Words of a text stay in its row: windows of 8 words are 64-bit hashes there, sorted in the row only where two are equal.
Time is n log n in a text's words. Partial sums go before the one shuffle (of hosts); the join back reads the rejected
hosts alone, from a table, so Spark sends them to all tasks if they are few, and splits a host of many rows if not.

Nulls: a null text has no words, fails the first rule and counts for its host. Documents of a null host belong to none:
they are held against the base rules alone. The empty host is a host. Null doc_ids are carried. Repeated rows count, and
are told, once each. Very long texts are treated whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW, HOST_LIMIT, LEAST_STRENGTH = 8, 0.5, 10  # hashes of windows are built by doubling, so 8 is fixed
SYMBOLS = "[#*$%&|<>]"
SPACES = r" \t\n\x0B\f\r"

#: Rules in the names of the measured columns; the first two are the base rules.
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
}
BASE = ("few_words", "repeated_words")

_WORDS = r"filter(split(replace(replace(replace(replace(replace(text, '\n', ' '), '\t', ' '), '\u000B', ' '), '\u000C', ' '), '\r', ' '), ' ', -1), x -> x <> '')"
_LINES = rf"filter(split(text, r'\n', -1), x -> x RLIKE r'[^{SPACES}]')"
#: Starts of windows that occur twice or more, in order; x is the hash of a window, i its place, s all of them sorted.
_TWICE = "sort_array(transform(filter(s, (e, j) -> (j > 0 AND s[j - 1].x = e.x) OR (j < size(s) - 1 AND s[j + 1].x = e.x)), e -> e.i))"
_COVERED = f"aggregate({_TWICE}, named_struct('n', 0L, 'last', -{WINDOW}), (a, i) -> named_struct('n', a.n + least({WINDOW}, i - a.last), 'last', i), a -> a.n)"


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with `name` standing for value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: Hashes of 2, 4, then 8 words from each place on.
_EIGHT = _let("b", "transform(a, (x, i) -> xxhash64(x, get(a, i + 2)))", f"transform(slice(b, 1, size(b) - {WINDOW - 1}), (x, i) -> xxhash64(x, b[i + 4]))")
_HASHES = _let("a", "transform(w, (x, i) -> xxhash64(x, get(w, i + 1)))", _EIGHT)
_SORTED = "sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i)))"
_REPEATED = f"IF(size(w) <= {WINDOW}, 0L, {_let('h', _HASHES, f'IF(size(array_distinct(h)) = size(h), 0L, {_let("s", _SORTED, _COVERED)})')})"
_OF_WORDS = _let("w", _WORDS, f"named_struct('n_words', bigint(size(w)), 'word_chars', bigint(length(array_join(w, ''))), 'n_repeat_words', {_REPEATED})")
_OF_LINES = _let("l", _LINES, "named_struct('n_lines', bigint(size(l)), 'n_dup_lines', bigint(size(l) - size(array_distinct(l))))")


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """Per row: doc_id, host, what is counted in its text, and whether it fails each of RULES."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id"), F.col(host).cast("string").alias("host"), text)
    rows = rows.select("doc_id", "host", "text", F.expr(_OF_WORDS).alias("words"), F.expr(_OF_LINES).alias("lines"))
    symbols = (F.size(F.split("text", SYMBOLS, -1)) - 1).cast("long").alias("n_symbols")
    counted = rows.select("doc_id", "host", "words.n_words", "words.word_chars", symbols, "lines.n_lines", "lines.n_dup_lines", "words.n_repeat_words")
    return counted.select("*", *[F.expr(rule).alias(name) for name, rule in RULES.items()])


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, n_docs, rule, n_failed, rate, shrunk): each host's rate of failures of each rule, and the shrunk one."""
    fails = [F.sum(F.col(name).cast("long")).alias(name) for name in RULES]
    hosts = measured.where("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *fails)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n_failed")) for name in RULES])).alias("x")
    rates = stored(hosts.select("host", "n_docs", each).select("host", "n_docs", "x.rule", "x.n_failed", (F.col("x.n_failed") / F.col("n_docs")).alias("rate")))
    prior = rates.groupBy("rule").agg(F.avg("rate").alias("m"), F.var_pop("rate").alias("v"), F.avg(1.0 / F.col("n_docs")).alias("one"))
    # what hosts differ by beyond the variance of drawing n documents of one rate
    prior = prior.select("rule", "m", F.expr("m * (1 - m)").alias("mm"), F.expr("v - m * (1 - m) * one").alias("beyond"))
    s = f"greatest(mm / beyond - 1, {LEAST_STRENGTH})"
    shrunk = F.expr(f"IF(beyond <= 0, m, (n_failed + {s} * m) / (n_docs + {s}))")
    return rates.join(F.broadcast(prior), "rule").select("host", "n_docs", "rule", "n_failed", "rate", shrunk.alias("shrunk"))  # a row per rule


def judge(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Each document's counts, base_failed, host_rejected and kept."""
    measured = stored(measure(docs, host))
    rejected = stored(host_rates(measured).where((F.col("shrunk") > limit) & (F.col("rate") > limit)).select("host").distinct())
    met = measured.join(rejected.withColumn("rejected", F.lit(True)), "host", "left")
    base = F.expr(" OR ".join(BASE))
    host_rejected = F.coalesce("rejected", F.lit(False))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return met.select("doc_id", *counts, base.alias("base_failed"), (~base & ~host_rejected).alias("kept"), host_rejected.alias("host_rejected"))


def drop_rejected(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of docs, all columns, whose doc_id has a kept row; doc_ids are taken to be distinct and filled."""
    kept = stored(judge(docs, host, limit).where("kept").select(F.col("doc_id").alias("kept_id")).distinct())
    return docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi")
