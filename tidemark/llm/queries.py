"""The queries of the text operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, langid, mainhtml, mixing, packing, quality, simhash, suffixdedup, tokens, urlfilter
from .common import table


def op1_language_id(spark, sf_dir):
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op2_mixing(spark, sf_dir):
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"))
    shards = F.transform("draws", lambda x: x["shard"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


def op3_nearest(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=20, query_every=20)


def op4_url_filter(spark, sf_dir):
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op5_simhash(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), size=3, max_bits=2)


def op6_quality(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark, sf_dir):
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_main_text(spark, sf_dir):
    return mainhtml.extract_main_text(table(spark, sf_dir, "pages"))


_QUERIES = (op1_language_id, op2_mixing, op3_nearest, op4_url_filter, op5_simhash, op6_quality, op7_suffix_dedup, op8_token_counts, op9_packing, op10_main_text)


def queries():
    return {f.__name__: f for f in _QUERIES}


_NEAREST_SQL = """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM good q JOIN good c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM pairs)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM ranked WHERE k <= 20"""

_QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
x AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
y AS (SELECT r, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS win FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
z AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM y WHERE win IS NOT NULL),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, unnest([0, 1, 2]) AS k FROM z WHERE c > 1) GROUP BY r),
ln AS (SELECT r, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines
  FROM d JOIN w USING (r) JOIN ln USING (r) LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR (n_dup_lines > 3 AND 100 * n_dup_lines > 30 * n_lines)) AS kept FROM b"""

_REPEATS_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT r, doc_id, h, length(h) // 2 AS n, unnest(range(length(h) // 2)) AS i FROM d),
w AS (SELECT r, doc_id, i, n, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN i + 50 <= n THEN substr(h, 2 * i + 1, 100) END AS win FROM b),
f AS (SELECT win, min(doc_id) AS least FROM w WHERE win IS NOT NULL GROUP BY win),
g AS (SELECT w.r, w.i, w.byte, coalesce(max(CASE WHEN f.least < w.doc_id THEN w.i END) OVER (PARTITION BY w.r ORDER BY w.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), -1) >= 0 AS gone FROM w LEFT JOIN f USING (win)),
l AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS before FROM g),
s AS (SELECT r, CAST(count(CASE WHEN gone THEN 1 END) AS BIGINT) AS n_removed, CAST(count(CASE WHEN gone AND NOT before THEN 1 END) AS BIGINT) AS n_spans, string_agg(CASE WHEN gone THEN '' ELSE byte END, '' ORDER BY i) AS kept FROM l GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN s USING (r)"""


def oracle_sql():
    """The others need tokenizers, XXH64, trained models or hashed draws, which SQL lacks."""
    return {"op3_nearest": _NEAREST_SQL, "op6_quality": _QUALITY_SQL, "op7_suffix_dedup": _REPEATS_SQL}
