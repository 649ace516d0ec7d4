"""The queries of this subpackage over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cellsift.llm import classifier, decontaminate, divergence, language, lines, packing, quality, search, shards, simhash, suffixes, tokens, warc
from cellsift.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_language_id")
def op1_language_id(spark, sf_dir):
    return language.predicted_languages(table(spark, sf_dir, "documents"))


@query("op2_token_counts")
def op2_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"), PIECES)


@query("op3_hilbert_shards")
def op3_hilbert_shards(spark, sf_dir):
    return shards.document_shards(table(spark, sf_dir, "documents")).drop("hilbert", "source", "lang")


@query("op4_simhash")
def op4_simhash(spark, sf_dir):
    return simhash.near_duplicate_components(table(spark, sf_dir, "documents"))


QUALITY_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce('=' || lang, '') AS l, coalesce('=' || source, '') AS s
  FROM documents
), words AS (
  SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)
), threes AS (
  SELECT r, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY r ORDER BY i)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS c FROM threes WHERE w3 IS NOT NULL) WHERE c > 1
), repeated AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), counted AS (
  SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY r
), lined AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT doc_id, l, s, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM d LEFT JOIN counted USING (r) LEFT JOIN lined USING (r) LEFT JOIN repeated USING (r)
), scored AS (
  SELECT *, 10000 * n_symbols // greatest(n_words, 1) AS symbols, 10000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
    100 * word_chars // greatest(n_words, 1) AS word_length
  FROM m
), entries AS (
  SELECT l, s, 'symbols' AS score, symbols AS v FROM scored UNION ALL SELECT l, s, 'dup_lines', dup_lines FROM scored
  UNION ALL SELECT l, s, 'word_length', word_length FROM scored
), sketch AS (
  SELECT l, s, score, (v >> z) << z AS bucket, count(*) AS n
  FROM (SELECT *, greatest(length(bin(v)) - 6, 0) AS z FROM entries) GROUP BY ALL
), least_spread AS (
  SELECT * FROM (VALUES ('symbols', 300), ('dup_lines', 1200), ('word_length', 100)) AS x(score, least)
), own AS (
  SELECT l, s, score, min(bucket) FILTER (upto * 4 >= total) AS q1, min(bucket) FILTER (upto * 4 >= total * 3) AS q3, max(total) AS total
  FROM (SELECT *, sum(n) OVER (PARTITION BY l, s, score ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY l, s, score) AS total FROM sketch)
  GROUP BY l, s, score
), wide AS (
  SELECT l, score, min(bucket) FILTER (upto * 4 >= total) AS q1, min(bucket) FILTER (upto * 4 >= total * 3) AS q3
  FROM (
    SELECT *, sum(n) OVER (PARTITION BY l, score ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY l, score) AS total
    FROM (SELECT l, score, bucket, sum(n) AS n FROM sketch GROUP BY ALL)
  ) GROUP BY l, score
), limits AS (
  SELECT l, s, score, CASE WHEN total >= 50 THEN own.q3 + 3 * greatest(own.q3 - own.q1, least) ELSE wide.q3 + 3 * greatest(wide.q3 - wide.q1, least) END AS most
  FROM own JOIN wide USING (l, score) JOIN least_spread USING (score)
), per_group AS (
  SELECT l, s, max(most) FILTER (score = 'symbols') AS a, max(most) FILTER (score = 'dup_lines') AS b, max(most) FILTER (score = 'word_length') AS c
  FROM limits GROUP BY l, s
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM scored JOIN per_group USING (l, s)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
  NOT base_failed AND symbols <= a AND dup_lines <= b AND word_length <= c AS kept
FROM judged
"""


@query("op5_quality_rules", QUALITY_SQL)
def op5_quality_rules(spark, sf_dir):
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS xs FROM documents)
), f AS (
  SELECT doc_id, x, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
), w AS (
  SELECT doc_id, p, x, lead(x) OVER o AS x2, lead(x, 2) OVER o AS x3 FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY p)
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY x, x2, x3 ORDER BY doc_id, p) AS k FROM w WHERE x3 IS NOT NULL) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, p + k AS p FROM later, (SELECT unnest([0, 1, 2]) AS k)
), cut AS (
  SELECT f.doc_id, f.i FROM f JOIN gone USING (doc_id, p)
), left_over AS (
  SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.i) FILTER (cut.i IS NULL) AS text,
    count(cut.i) AS removed_lines, count(*) FILTER (cut.i IS NULL AND regexp_matches(l.x, '[^\x20\x09-\x0D]')) AS full_lines
  FROM l LEFT JOIN cut ON l.doc_id = cut.doc_id AND l.i = cut.i GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN coalesce(removed_lines, 0) = 0 THEN d.text WHEN full_lines = 0 THEN '' ELSE c.text END AS text,
  coalesce(removed_lines, 0) AS removed_lines
FROM documents d LEFT JOIN left_over c USING (doc_id)
"""


@query("op6_line_dedup", LINES_SQL)
def op6_line_dedup(spark, sf_dir):
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_lines")


@query("op7_packing")
def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), WORDS)


WARC_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), held AS (
  SELECT payload_digest, max(page_id) AS held FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN held IS NULL OR page_id = held THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> held THEN held END AS refers_to
FROM p LEFT JOIN held USING (payload_digest)
"""


@query("op8_warc", WARC_SQL)
def op8_warc(spark, sf_dir):
    path = scratch_path(spark, "warc")
    index = warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, index).drop("url", "payload")


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text")


@query("op10_decontamination")
def op10_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT r, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM d)
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 3
), groups AS (
  SELECT DISTINCT lang, source FROM d
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (
  SELECT lang, count(*) AS v, sum(n) AS lang_n FROM kept GROUP BY lang
), totals AS (
  SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(t.n, 0) + v) AS p,
    1 + 1000000000::HUGEINT * (k.n + 1) // (lang_n + v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN totals t USING (lang, source)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 200
"""


@query("op11_source_divergence", DIVERGENCE_SQL)
def op11_source_divergence(spark, sf_dir):
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


@query("op12_quality_classifier")
def op12_quality_classifier(spark, sf_dir):
    return classifier.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


SEARCH_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents
), words AS (
  SELECT r, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT r, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM d)
), sizes AS (
  SELECT r, count(*) AS n FROM words GROUP BY r
), whole AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes
), norms AS (
  SELECT r, 100 - 25 + (25 * n * docs) // terms AS m FROM sizes, whole
), asked AS (
  SELECT item_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS k
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY ALL
), held AS (
  SELECT r, term, count(*) AS tf FROM words SEMI JOIN asked USING (term) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), whole
), scores AS (
  SELECT item_id, r, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN norms USING (r) GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores JOIN d USING (r) WHERE score > 0)
WHERE rank <= 20
"""


@query("op13_lexical_search", SEARCH_SQL)
def op13_lexical_search(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
