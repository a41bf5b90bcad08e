"""The registered queries of the corpus operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, language, licenses, line_dedup, merkle, nearest, ngram_join, packing, passages, periods, quality, urls


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(_table(spark, folder, "documents"), k=4, num=85, den=100)


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, folder, "documents"))


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op6_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    rows = nearest.clean(_table(spark, folder, "embeddings"))
    return nearest.search(rows, rows.where("vec_id % 20 = 0"))


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, folder, "documents"))


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents"))


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"))


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.classify(_table(spark, folder, "documents"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periods.digests(_table(spark, folder, "documents"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verify_tampered(_table(spark, folder, "documents"))


#: Line dedup as SQL: keys, their documents and what stays.
OP5_SQL = r"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents),
keyed AS (
  SELECT doc_id, n, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM cut),
gone AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE gone.k IS NOT NULL AND doc_id <> keep) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE gone.k IS NULL OR doc_id = keep), '')) AS kept_sha256
FROM keyed LEFT JOIN gone USING (k)
GROUP BY doc_id
"""

#: The manifest as SQL: all levels of the sources' trees and of the tree over them, each leaf's steps, and the steps folded.
OP13_SQL = r"""
WITH RECURSIVE
fields AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS f,
    list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::UBIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))) AS crc
  FROM documents),
hashed AS (
  SELECT doc_id, source, sha256(f || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295::UBIGINT) % 2 = 0
      THEN sha256(f || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS altered
  FROM fields),
leaves AS (
  SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n FROM hashed),
nodes AS (
  SELECT 0 AS level, source, pos, leaf AS d, n FROM leaves
  UNION ALL
  SELECT level + 1, source, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY level, source, pos // 3, n),
tops AS (
  SELECT source, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, pos, d, n FROM tops
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (n + 2) // 3 FROM upper WHERE n > 1 GROUP BY level, pos // 3, n),
below AS (
  SELECT l.r, 0 AS tree, h.level, l.source, l.pos // (3 ** h.level)::BIGINT AS pos
  FROM leaves l JOIN (SELECT DISTINCT level, source FROM nodes WHERE n > 1) h ON h.source IS NOT DISTINCT FROM l.source),
above AS (
  SELECT l.r, 1 AS tree, h.level, t.pos // (3 ** h.level)::BIGINT AS pos
  FROM leaves l JOIN tops t ON t.source IS NOT DISTINCT FROM l.source, (SELECT DISTINCT level FROM upper WHERE n > 1) h),
met AS (
  SELECT b.r, b.tree, b.level, b.pos AS own, x.pos, x.d FROM below b JOIN nodes x
    ON x.source IS NOT DISTINCT FROM b.source AND x.level = b.level AND x.pos // 3 = b.pos // 3
  UNION ALL
  SELECT a.r, a.tree, a.level, a.pos, x.pos, x.d FROM above a JOIN upper x ON x.level = a.level AND x.pos // 3 = a.pos // 3),
steps AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY tree, level) AS k, coalesce(string_agg(d, '' ORDER BY pos) FILTER (WHERE pos < own), '') AS lft,
    coalesce(string_agg(d, '' ORDER BY pos) FILTER (WHERE pos > own), '') AS rgt FROM met GROUP BY r, tree, level),
folded AS (
  SELECT r, 0 AS k, coalesce(altered, leaf) AS d FROM leaves
  UNION ALL
  SELECT s.r, s.k, sha256(s.lft || f.d || s.rgt) FROM folded f JOIN steps s ON s.r = f.r AND s.k = f.k + 1),
proofs AS (SELECT r, string_agg(lft || rgt, '' ORDER BY k) AS p FROM steps GROUP BY r)
SELECT l.doc_id, l.leaf, t.d AS subroot, u.d AS root, sha256(coalesce(p.p, '')) AS proof_sha256, f.d AS folded_root, f.d = u.d AS verified
FROM leaves l JOIN tops t ON t.source IS NOT DISTINCT FROM l.source JOIN (SELECT d FROM upper WHERE n = 1) u ON TRUE
LEFT JOIN proofs p ON p.r = l.r JOIN (SELECT r, arg_max(d, k) AS d FROM folded GROUP BY r) f ON f.r = l.r
"""

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_bpe": op4_bpe,
    "op5_line_dedup": op5_line_dedup,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_fingerprints": op7_fingerprints,
    "op8_license_scan": op8_license_scan,
    "op9_url_filter": op9_url_filter,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_language_id": op11_language_id,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES = {"op5_line_dedup": OP5_SQL, "op13_merkle_manifest": OP13_SQL}
