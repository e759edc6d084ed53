"""Queries over the whole tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surety.llm import html_text, importance, masked_lm, ngram_join, packing, pii, poisson_mix, quality, secrets, tiff, tokens, toxicity, whitening
from surety.llm.common import secret, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["ord"] < len(secrets.BASE))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in secrets.BASE], F.sha2(secrets.span_list(base), 256).alias("base_sha256"), secrets.span_list(F.col("secrets")).alias("spans"))


def op2_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tiff.store(table(spark, sf_dir, "documents"))
    stored = stored.withColumns({"media_bytes": F.length("media").cast("bigint"), "media_sha256": F.sha2("media", 256)})
    out = tiff.digest_pages(tiff.tiff_pages(stored), ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokens.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


def op4_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), secret(spark))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return masked_lm.score(docs, masked_lm.fit(docs))


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = poisson_mix.poisson_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", F.col("copy").cast("bigint").alias("copy"), "shuffle_key")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op11_chan_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_toxicity_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


BUILT = (
    op1_secret_scan,
    op2_tiff_pages,
    op3_token_counts,
    op4_quality_forest,
    op5_pii_feistel,
    op6_best_fit_packing,
    op7_host_suffix_array,
    op8_masked_likelihood,
    op9_poisson_mix,
    op10_ngram_jaccard,
    op11_chan_whitening,
    op12_importance_resample,
    op13_toxicity_channel,
)
QUERIES = {f.__name__: f for f in BUILT}


def _secret_sql() -> str:
    parts = []
    for i, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("'", "''")
        sized = f"regexp_extract_all(t, '{pattern}', {r.measured})"
        parts.append(f"""
          SELECT id, h.start AS s, {i} AS o, '{r.kind}' AS k, h.stop AS e FROM (
            SELECT id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
              'start': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
              'stop': list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))),
              'part': p[i]}})) AS h
            FROM (SELECT id, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS m, {sized} AS p FROM d WHERE regexp_matches(t, '{pattern}')))
          WHERE length(h.part) >= {r.least}""")
    return f"""WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents),
      s AS (SELECT id, s::BIGINT AS s, o, k, e::BIGINT AS e FROM ({' UNION ALL '.join(parts)})),
      a AS (SELECT id, count(*) FILTER (k = 'assign') AS na, count(*) FILTER (k = 'access') AS nc, count(*) FILTER (k = 'hex') AS nh,
        string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3) AS b, string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, o) AS l FROM s GROUP BY id)
      SELECT d.id AS doc_id, coalesce(na, 0) AS n_assign, coalesce(nc, 0) AS n_access, coalesce(nh, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(l, '') AS spans
      FROM d LEFT JOIN a ON d.id = a.id"""


_POISSON_SQL = """WITH n AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
  r AS (SELECT source, sqrt(n) / (SELECT sum(sqrt(n)) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
  c AS (SELECT source, list_transform(range(0, cast(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1), lambda k: list_sum(list_transform(range(0, k + 1), lambda i: exp(-rate + i * ln(rate) - lgamma(i + 1))))) AS cdf FROM r),
  k AS (SELECT doc_id, text, lang, d.source, n_chars, len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5('17:' || doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496.0)) AS k FROM documents d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
  e AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, k + 1)) AS copy FROM k)
  SELECT doc_id, text, lang, source, n_chars, copy, ('0x' || substr(md5('17:order:' || doc_id || ':' || copy), 1, 13))::BIGINT AS shuffle_key FROM e"""

_JACCARD_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM w),
  e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
  o AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
  f AS (SELECT e.* FROM e JOIN o USING (g)),
  l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.g = b.g GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
  r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
  SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, (SELECT min(r.b) FROM r WHERE r.a = s.doc_id) AS component_id FROM s"""

def _importance_sql() -> str:
    changes = ", ".join(map(str, importance.crc_table().tolist()))
    return rf"""WITH w AS (SELECT kind, doc_id, row, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM (SELECT 0 AS kind, doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents UNION ALL SELECT 1, 0, 0, coalesce(text, '') FROM benchmark)),
  f AS (SELECT kind, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
  c AS (SELECT kind, row, f, count(*) AS n FROM f GROUP BY ALL),
  h AS (SELECT f, xor(list_reduce(list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, ([{changes}]::BIGINT[])[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS b FROM (SELECT DISTINCT f FROM c)),
  b AS (SELECT kind, row, b, sum(n)::BIGINT AS n FROM c JOIN h USING (f) GROUP BY ALL),
  k AS (SELECT b, coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS t FROM b GROUP BY b),
  g AS (SELECT b, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM k) + 10000) / ((s + 1) * ((SELECT sum(t) FROM k) + 10000))))::BIGINT AS gain FROM k),
  d AS (SELECT row, sum(n)::BIGINT AS n, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM b JOIN g USING (b) WHERE kind = 0 GROUP BY row),
  s AS (SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN d USING (row) WHERE kind = 0),
  r AS (SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) END AS place, 25 * count(*) FILTER (words >= 20) OVER () // 100 AS drawn FROM s)
  SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM r"""


#: What is left of a page without its head, comments, menus, adverts and footer, cut at tags of blocks. Entities are
#: decoded in one pass by keeping & apart.
_REST_SQL = r"""WITH a AS (SELECT page_id, url, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->|<head>.*?</head>|<nav>.*?</nav>|<div class="ad">.*?</div>|<footer>.*?</footer>', chr(2), 'g') AS t FROM pages),
  l AS (SELECT page_id, url, list_concat([''], string_split(regexp_replace(t, '<!DOCTYPE html>|</?(?:html|body|article|p|h1)(?: [^>]*)?>', chr(2), 'g'), chr(2))) AS l FROM a),
  b AS (SELECT page_id, url, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM l),
  c AS (SELECT page_id, url, i, regexp_replace(regexp_replace(t, '<br>', ' ', 'g'), '<[^>]+>', '', 'g') AS t FROM b),
  d AS (SELECT page_id, url, i, replace(replace(replace(replace(replace(replace(replace(t, '&amp;', chr(1)), '&amp', chr(1)), '&quot;', '"'), '&quot', '"'), '&lt;', '<'), '&gt;', '>'), chr(1), '&') AS t FROM c),
  e AS (SELECT page_id, url, i, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM d),
  f AS (SELECT page_id, url, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (t <> ''), '') AS text FROM e GROUP BY page_id, url)
  SELECT page_id, url, text, length(text) AS n_chars FROM f"""

ORACLES = {"op7_host_suffix_array": _REST_SQL, "op1_secret_scan": _secret_sql(), "op9_poisson_mix": _POISSON_SQL, "op10_ngram_jaccard": _JACCARD_SQL, "op12_importance_resample": _importance_sql()}
