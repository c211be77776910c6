"""The numbered queries: each applies one operator to its whole table and returns its digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washbay.llm import bpe, conversations, exact_dedup, hamming, licenses, line_dedup, maxent_lm, ngram_join, packing, quality, spelling, suffix_dedup, token_files
from washbay.llm.common import staged_path
from washbay.llm.registry import register, table, tokenizer_path

OP1_SQL = """
WITH codes AS (
  SELECT DISTINCT vec_id, bits FROM (
    SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings)),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id,
         CAST(list_sum(list_transform(list_zip(q.bits, c.bits), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM codes q JOIN codes c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, neighbor_id, distance FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM pairs)
WHERE rank <= 10
"""


@register("op1_hamming_top_k", OP1_SQL)
def op1_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hamming.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
                                      WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, s.n
"""


@register("op2_ngram_jaccard", OP2_SQL)
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"), size=3, num=9, den=10)


@register("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_filter(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "stratum", "score", "cut")


@register("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.kept_digests(table(spark, sf_dir, "documents"))


@register("op5_maxent_lm")
def op5_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score_documents(table(spark, sf_dir, "documents"))


@register("op6_bpe_round_trip")
def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path())


@register("op7_token_files")
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staged_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=1)
    return token_files.token_positions(spark, path)


@register("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)


@register("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
drops AS (
  SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, d.holder IS NOT NULL AND l.doc_id <> d.holder AS gone FROM keyed l LEFT JOIN drops d USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@register("op10_line_dedup", OP10_SQL)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@register("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_forms(table(spark, sf_dir, "documents"), damage=31)


OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i:
           CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, n::BIGINT)) AS t),
faults AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                                        lambda x: ascii(x)::BIGINT),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS f
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM faults WHERE f <> 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, left(role, 1) AS i FROM damaged),
judged AS (
  SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY place) AS prev,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault FROM ranked),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE prev IS NOT NULL AND prev || i NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
rows_of AS (
  SELECT conv_id, place, role, text, i, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000000::BIGINT WHEN fault = 'truncated' THEN 3::BIGINT ELSE 0::BIGINT END AS x FROM judged),
ways AS (
  SELECT conv_id, 0::BIGINT AS place, {'c': 0::BIGINT, 'a': '', 'r': ''} AS n, {'c': 1000000000000::BIGINT, 'a': '', 'r': ''} AS s,
         {'c': 3::BIGINT, 'a': 'I', 'r': chr(10) || 'user:'} AS u,
         {'c': 6::BIGINT, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'} AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, place, n, s, u, list_min([a, {'c': u.c + 3, 'a': u.a || 'I', 'r': u.r || chr(10) || 'assistant:'}]) AS a
  FROM (
    SELECT conv_id, place, n, s, a, list_min([u, {'c': n.c + 3, 'a': n.a || 'I', 'r': n.r || chr(10) || 'user:'},
             {'c': s.c + 3, 'a': s.a || 'I', 'r': s.r || chr(10) || 'user:'}, {'c': a.c + 3, 'a': a.a || 'I', 'r': a.r || chr(10) || 'user:'}]) AS u
    FROM (
      SELECT w.conv_id, r.place,
             {'c': w.n.c + 4, 'a': w.n.a || 'D', 'r': w.n.r} AS n,
             list_min([{'c': w.s.c + 4, 'a': w.s.a || 'D', 'r': w.s.r},
                       {'c': w.n.c + x + CASE WHEN i = 's' THEN 0 ELSE 1000000000000 END, 'a': w.n.a || 'K', 'r': w.n.r || chr(10) || r.role || ':' || r.text}]) AS s,
             list_min([{'c': w.u.c + 4, 'a': w.u.a || 'D', 'r': w.u.r},
                       {'c': w.n.c + x + CASE WHEN i = 'u' THEN 0 ELSE 1000000000000 END, 'a': w.n.a || 'K', 'r': w.n.r || chr(10) || r.role || ':' || r.text},
                       {'c': w.s.c + x + CASE WHEN i = 'u' THEN 0 ELSE 1000000000000 END, 'a': w.s.a || 'K', 'r': w.s.r || chr(10) || r.role || ':' || r.text},
                       {'c': w.a.c + x + CASE WHEN i = 'u' THEN 0 ELSE 1000000000000 END, 'a': w.a.a || 'K', 'r': w.a.r || chr(10) || r.role || ':' || r.text},
                       {'c': w.n.c + x + 3, 'a': w.n.a || 'R', 'r': w.n.r || chr(10) || 'user:' || r.text},
                       {'c': w.s.c + x + 3, 'a': w.s.a || 'R', 'r': w.s.r || chr(10) || 'user:' || r.text},
                       {'c': w.a.c + x + 3, 'a': w.a.a || 'R', 'r': w.a.r || chr(10) || 'user:' || r.text}]) AS u,
             list_min([{'c': w.a.c + 4, 'a': w.a.a || 'D', 'r': w.a.r},
                       {'c': w.u.c + x + CASE WHEN i = 'a' THEN 0 ELSE 1000000000000 END, 'a': w.u.a || 'K', 'r': w.u.r || chr(10) || r.role || ':' || r.text},
                       {'c': w.u.c + x + 3, 'a': w.u.a || 'R', 'r': w.u.r || chr(10) || 'assistant:' || r.text}]) AS a
      FROM ways w JOIN rows_of r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.place = w.place + 1))),
done AS (
  SELECT w.conv_id, list_min([w.n, w.a]) AS f, k.* EXCLUDE (conv_id)
  FROM ways w LEFT JOIN counted k ON k.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.place = coalesce(k.n, 0))
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, f.c AS cost, f.a AS audit, sha256(substr(f.r, 2)) AS repaired_sha256
FROM done
"""


@register("op12_conversation_repair", OP12_SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(conversations.damaged(table(spark, sf_dir, "conversations")), "live")


OP13_SQL = """
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM documents),
groups AS (SELECT k, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY k)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.k) AS text_sha256
FROM texts t JOIN groups g USING (k)
"""


@register("op13_exact_dedup", OP13_SQL)
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
