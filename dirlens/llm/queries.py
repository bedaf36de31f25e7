"""The queries of the training-data operators, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import align
from .ann import nearest
from .decontaminate import find_contaminated
from .host_rules import judge
from .jaccard_join import join_components
from .line_dedup import dedup_lines
from .lm_score import score_documents
from .packing import pack
from .pii import find_pii
from .suffix_dedup import find_repeats
from .toxicity import score_toxicity
from .warc import read_packages, write_packages
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), _tokenizer())


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = write_packages(_table(spark, sf_dir, "pages"))
    return read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(_table(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_packing, op2_warc, op3_decontamination, op4_toxicity, op5_line_dedup, op6_jaccard_join, op7_lm_score, op8_suffix_dedup, op9_ann, op10_pii, op11_host_rules, op12_alignment, op13_whitening]
    return {f.__name__: f for f in found}


_OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS least FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN least IS NULL OR least = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN least <> page_id THEN least END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND payload_bytes >= 100
"""


#: For documents of distinct, filled doc_ids.
_OP5_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
m AS (SELECT doc_id, pos, line, regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM l),
t AS (SELECT doc_id, pos, line, m, string_split(m, ' ') AS t, len(string_split(m, ' ')) AS n FROM m),
e AS (SELECT doc_id, pos, m AS key, CASE WHEN n >= 3 THEN 2 ELSE 3 END AS least FROM t WHERE regexp_matches(m, '\p{L}')),
often AS (SELECT key, min(doc_id) AS first_id FROM e GROUP BY key, least HAVING count(DISTINCT doc_id) >= least),
node AS (SELECT doc_id, pos, t, n, h, concat(n, ' ', h, ' ', array_to_string(t[1:h], ' ')) AS key FROM t, (VALUES (2), (4)) AS v(h) WHERE n > h),
large AS (SELECT key, min(doc_id) AS first_id FROM node GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
run AS (SELECT key, i, array_to_string(t[(i * n) // least(16, n) + 1:((i + 1) * n) // least(16, n)], ' ') AS run
        FROM node SEMI JOIN large USING (key), range(16) AS r(i) WHERE i < least(16, n) AND (i * n) // least(16, n) >= h),
same AS (SELECT key, i, count(DISTINCT run) = 1 AND NOT regexp_full_match(min(run), '<\*>( <\*>)*') AS same FROM run GROUP BY 1, 2),
template AS (SELECT key FROM same GROUP BY 1 HAVING 2 * count(*) FILTER (same) >= count(*)),
bad AS (SELECT doc_id, pos FROM e JOIN often USING (key) WHERE doc_id > first_id
        UNION SELECT doc_id, pos FROM node JOIN large USING (key) SEMI JOIN template USING (key) WHERE doc_id > first_id),
kept AS (SELECT t.doc_id, string_agg(line, chr(10) ORDER BY t.pos) AS text, count(*) AS n FROM t LEFT JOIN bad ON t.doc_id = bad.doc_id AND t.pos = bad.pos WHERE bad.pos IS NULL GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       coalesce(len(lines), 0)::INTEGER AS n_lines, (coalesce(len(lines), 0) - coalesce(kept.n, 0))::INTEGER AS n_dropped
FROM d LEFT JOIN kept USING (doc_id)
"""


#: Every pair that shares a shingle; for small tables of distinct, filled doc_ids.
_OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(2, len(ws) - 3))) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY 1) c ON c.a = w.doc_id
"""


_OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 6)) AS i) WHERE len(ws) >= 8),
often AS (SELECT r, g FROM g GROUP BY 1, 2 HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM g SEMI JOIN often USING (r, g), range(8) AS j(j) GROUP BY 1),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT d.r, doc_id, host, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN covered USING (r)),
f AS (SELECT *, n_words < 20 AS r1, 100 * n_repeat_words > 30 * n_words AS r2, 100 * n_dup_lines > 30 * n_lines AS r3,
             10 * n_symbols > n_words AS r4, word_chars < 2 * n_words OR word_chars > 12 * n_words AS r5 FROM m),
h AS (SELECT host, rule, count(*) AS n, count(*) FILTER (failed) AS k
      FROM (SELECT host, unnest(range(5)) AS rule, unnest([r1, r2, r3, r4, r5]) AS failed FROM f WHERE host IS NOT NULL) GROUP BY 1, 2),
p AS (SELECT rule, avg(k / n) AS m, var_pop(k / n) - avg(k / n) * (1 - avg(k / n)) * avg(1 / n) AS beyond FROM h GROUP BY 1),
s AS (SELECT *, CASE WHEN beyond > 0 THEN greatest(m * (1 - m) / beyond - 1, 10) END AS s FROM p),
rejected AS (SELECT DISTINCT host FROM h JOIN s USING (rule) WHERE k / n > 0.5 AND CASE WHEN s IS NULL THEN m ELSE (k + s * m) / (n + s) END > 0.5)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, r1 OR r2 AS base_failed, NOT (r1 OR r2) AND rejected.host IS NULL AS kept, rejected.host IS NOT NULL AS host_rejected
FROM f LEFT JOIN rejected USING (host)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": _OP2_SQL, "op5_line_dedup": _OP5_SQL, "op6_jaccard_join": _OP6_SQL, "op11_host_rules": _OP11_SQL}
