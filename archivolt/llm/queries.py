"""The operators of this folder as queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm import chat, classifier, fingerprints, html_text, lexical, line_dedup, lm_score, packing, quality_rules, simhash, token_files, vector_codes, word_bpe
from archivolt.llm.common import documents

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_next(documents(spark, sf_dir))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scored(documents(spark, sf_dir))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encoded(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), digests=True)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash_near_dedup, op2_chat_formatting, op3_document_fingerprints, op4_lm_scoring, op5_bpe_round_trip, op6_quality_rules, op7_line_dedup, op8_token_files, op9_quality_classifier, op10_packing, op11_html_extraction, op12_vector_codes, op13_lexical_search)
}

OP2_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
p AS (
  SELECT conv_id, k, n, string_agg(length(r) || ':' || r || length(x) || ':' || x, '') OVER (PARTITION BY conv_id ORDER BY k) AS said,
         string_agg('<|' || r || '|>' || chr(10) || x || '<|end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY k) AS chat
  FROM t),
w AS (SELECT said, min(conv_id) AS conv_id, min(n) AS n_turns, count(*) AS n_copies, any_value(chat) AS chat FROM p WHERE k = n GROUP BY said)
SELECT conv_id, n_turns, n_copies, chat FROM w WHERE said NOT IN (SELECT said FROM p WHERE k < n)
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (
  SELECT doc_id, n, i, CASE WHEN i + 3 <= n THEN w[i:i + 3] END AS a, CASE WHEN i + 7 <= n THEN w[i:i + 7] END AS b,
         CASE WHEN i + 50 <= n THEN md5(array_to_string(w[i:i + 50], ' ')) END AS c FROM s),
r AS (
  SELECT doc_id, n, i,
         CASE WHEN a IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, a) > 1 THEN i + 3 END AS a_end,
         CASE WHEN b IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, b) > 1 THEN i + 7 END AS b_end,
         c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, c) > 1 AS long FROM g),
m AS (
  SELECT doc_id, coalesce(max(a_end) OVER o >= i, false) AS in_a, coalesce(max(b_end) OVER o >= i, false) AS in_b, long
  FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, count_if(in_a) AS n_covered, count_if(in_b) AS n_repeat_words, bool_or(long) AS long FROM m GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
x AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_covered, 0) AS BIGINT) AS n_covered, coalesce(long, false) AS long
  FROM d LEFT JOIN f USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_covered <= 0.4 * n_words AND NOT long AS kept, n_covered
FROM x
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(g.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE g.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN g USING (key) GROUP BY doc_id
"""

#: The pages of the given tables declare their article, so SQL can cut it out; their
#: character references are these.
OP11_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
b AS (SELECT page_id, unnest(string_split(regexp_replace(a, '</?(p|h1)>|<br>', chr(1), 'g'), chr(1))) AS b, generate_subscripts(string_split(regexp_replace(a, '</?(p|h1)>|<br>', chr(1), 'g'), chr(1)), 1) AS k FROM a),
c AS (SELECT page_id, k, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(b, '<[^>]*>', '', 'g'), '&(lt|gt|quot|amp)(?:;|$)', '&\1;', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM b)
SELECT page_id, any_value(url) AS url, coalesce(string_agg(t, chr(10) ORDER BY k) FILTER (WHERE t <> ''), '') AS text, CAST(length(coalesce(string_agg(t, chr(10) ORDER BY k) FILTER (WHERE t <> ''), '')) AS BIGINT) AS n_chars
FROM c JOIN pages USING (page_id) GROUP BY page_id
"""


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Op12 as rounds of common table expressions; sums and products of integers below 2^53
    are exact in doubles."""
    out = f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, i AS part, v[1 + i * len(v) // {parts}:(i + 1) * len(v) // {parts}] AS x FROM k, range({parts}) r(i)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < {entries})"""
    for r in range(rounds + 1):
        out += f""",
a{r} AS MATERIALIZED (
  SELECT vec_id, label, part, x, min_by(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT vec_id, label, part, x, entry, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM p JOIN c{r} USING (part)) GROUP BY ALL)"""
        if r < rounds:
            out += f""",
u{r} AS (SELECT part, entry, list(s ORDER BY pos) AS c FROM (SELECT part, entry, pos, floor(sum(y) / count(*)) AS s FROM (SELECT part, entry, unnest(x) AS y, generate_subscripts(x, 1) AS pos FROM a{r}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(u{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN u{r} USING (part, entry))"""
    return out + f""",
e AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256 FROM e
"""


OP13_SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1), s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM n),
t AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY 1), s),
r AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total)))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN w USING (term) JOIN n USING (doc_id), s GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 10
"""

ORACLE = {"op2_chat_formatting": OP2_SQL, "op6_quality_rules": OP6_SQL, "op7_line_dedup": OP7_SQL, "op11_html_extraction": OP11_SQL, "op12_vector_codes": codes_sql(), "op13_lexical_search": OP13_SQL}
