"""One query per operator over its whole table, and SQL twins where SQL can say the same."""

from __future__ import annotations

import public_tokenizers

from convolytics.llm import (
    alignment,
    fingerprints,
    jaccard,
    languages,
    leaks,
    licenses,
    pieces,
    quality,
    secrets,
    spelling,
    substrings,
    urls,
    warc,
)
from convolytics.llm.common import small_batches

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf_dir: str, name: str):
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_ngram_jaccard(spark, sf_dir):
    return jaccard.linked(table(spark, sf_dir, "documents"))


@query
def op6_substring_dedup(spark, sf_dir):
    return substrings.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op5_benchmark_decontamination(spark, sf_dir):
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_sentencepiece(spark, sf_dir):
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.token_digests(table(spark, sf_dir, "documents"), path)


@query
def op9_secret_scan(spark, sf_dir):
    return secrets.digests(table(spark, sf_dir, "documents"))


@query
def op3_url_filter(spark, sf_dir):
    return urls.filter_urls(table(spark, sf_dir, "pages"))


_HOSTS = ", ".join(f"'{h}'" for h in urls.BLOCKED_HOSTS)
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)
ORACLES["op3_url_filter"] = rf"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), rules(h, p, v) AS (VALUES {_RULES}), best AS (
  SELECT host, path, max_by((h || p, v), length(h || p) * 1000 + length(h)) AS r
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path
)
SELECT page_id, parts.host, parts.path, r[1] AS rule,
  coalesce(r[2], CASE WHEN regexp_matches(parts.host,
    '(^|\.)(' || replace(concat_ws('|', {_HOSTS}), '.', '\.') || ')$')
    THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best ON best.host = parts.host AND best.path = parts.path
"""


@query
def op10_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("offset")


ORACLES["op10_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), last AS (
  SELECT html, max(page_id) AS response FROM p WHERE n >= 1000 GROUP BY html HAVING count(*) > 1
)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN response <> page_id OR (response IS NOT NULL AND page_id IS NULL)
    THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN response <> page_id OR page_id IS NULL THEN response END AS refers_to
FROM p LEFT JOIN last ON last.html = p.html AND p.n >= 1000
"""


@query
def op1_quality(spark, sf_dir):
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_language_id(spark, sf_dir):
    return languages.predictions(table(spark, sf_dir, "documents"))


@query
def op2_fingerprints(spark, sf_dir):
    return fingerprints.compared(table(spark, sf_dir, "documents"))


@query
def op12_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op11_license_scan(spark, sf_dir):
    return licenses.labels(table(spark, sf_dir, "documents"))


@query
def op13_tokenizer_alignment(spark, sf_dir):
    names = ("byte_bpe_50k.json", "piece_bpe_32k.model")
    return alignment.alignments(
        table(spark, sf_dir, "documents"), *[public_tokenizers.path(n) for n in names]
    )
