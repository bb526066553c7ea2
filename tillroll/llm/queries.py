"""The registered corpus queries: thin wrappers that run each operator with its
production parameters over a whole table, and their DuckDB SQL where SQL can
express the result."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import (bpe, jaccard, langid, manifest, packing, pieces, quality, resample, secrets, substrings,
                          tokens, topk, urls)

#: Folder of the public tokenizer files; by default that of the installed package.
TOKENIZERS = os.environ.get("TILLROLL_TOKENIZERS", "")

#: Rules of the url query (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"),
             ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def vocabulary(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), words=4, num=85, den=100)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digest(documents(spark, sf_dir), window=20)


def op5_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, "vec_id % 100 = 0", k=10, scale=1024)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), limit=2048)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), 4096, end_id=1)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample.resample(documents(spark, sf_dir), target, percent=5, least_words=20, seed=42)


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_ngram_jaccard, op3_language_id, op4_substring_dedup, op5_pivot_topk,
    op6_byte_bpe, op7_url_filter, op8_token_counts, op9_secret_scan, op10_best_fit_packing,
    op11_importance_resampling, op12_piece_bpe, op13_merkle_manifest)}

ORACLES: dict[str, str] = {}

#: Words of a text, A-Z lower-cased (translate leaves other letters as they are).
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

ORACLES["op2_ngram_jaccard"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}')")} AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s
  FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY 1, 2
  HAVING 100 * count(*) >= 85 * (min(a.n) + min(b.n) - count(*))),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles,
       least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""

ORACLES["op4_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
x AS (
  SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM x) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS k
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

ORACLES["op5_pivot_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM r WHERE r <= 10
"""

ORACLES["op7_url_filter"] = """
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path
  FROM u),
rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(rhost, rpath, verdict)),
hit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN hit USING (page_id)
"""

#: CRC-32 a byte at a time; its table follows from the polynomial.
_CRC_TABLE = "[" + ", ".join(map(str, resample._byte_table().tolist())) + "]::BIGINT[]"
_CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {{bytes}}),
           lambda c, b: xor(({_CRC_TABLE})[CAST((xor(c, b) & 255) + 1 AS INT)], c >> 8)), 4294967295::BIGINT)"""
_BYTES = """list_transform(range(1, len({hex}) + 1, 2), lambda i: CAST(
           16 * (instr('0123456789ABCDEF', {hex}[i]) - 1) + instr('0123456789ABCDEF', {hex}[i + 1]) - 1 AS BIGINT))"""

ORACLES["op11_importance_resampling"] = rf"""
WITH texts AS (
  SELECT TRUE AS source, doc_id, text FROM documents
  UNION ALL SELECT FALSE, NULL, text FROM benchmark),
w AS (
  SELECT source, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (
  SELECT source, doc_id, unnest(list_concat(w, list_concat(
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS f FROM w),
per AS (SELECT source, doc_id, f, count(*) AS n FROM f GROUP BY ALL),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM per)),
bytes AS (SELECT f, {_BYTES.format(hex="h")} AS b FROM hexed),
buckets AS (SELECT f, {_CRC.format(bytes="b")} % 10000 AS bucket FROM bytes),
held AS (SELECT source, doc_id, bucket, sum(n) AS n FROM per JOIN buckets USING (f) GROUP BY ALL),
shares AS (SELECT bucket, coalesce(sum(n) FILTER (source), 0)::DOUBLE AS s,
                  coalesce(sum(n) FILTER (NOT source), 0)::DOUBLE AS t FROM held GROUP BY bucket),
totals AS (SELECT sum(s) AS ss, sum(t) AS tt FROM shares),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS gain
         FROM shares, totals),
weight AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM held JOIN gain USING (bucket) WHERE source GROUP BY doc_id),
scored AS (
  SELECT w.doc_id, len(w.w) AS n_words, len(w.w) + greatest(len(w.w) - 1, 0) + greatest(len(w.w) - 2, 0) AS n_features,
         coalesce(weight, 0) AS weight,
         list_reduce(list_transform(range(1, 9), lambda i: CAST(
           instr('0123456789abcdef', sha256('42:' || w.doc_id)[i]) - 1 AS BIGINT)), lambda a, b: 16 * a + b) AS h
  FROM w LEFT JOIN weight USING (doc_id) WHERE source),
noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM scored),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n
           FROM noisy WHERE n_words >= 20)
SELECT noisy.doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
       CASE WHEN r <= 5 * n // 100 THEN r END AS rank
FROM noisy LEFT JOIN ranked USING (doc_id)
"""

_FIELD = "CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
_LEAF = " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars"))
_RUN = "sha256(array_to_string(list_slice(nodes, 8 * i + 1, 8 * i + 8), ''))"
_SIBLINGS = ("array_to_string(list_concat(list_slice(nodes, pos - pos % 8 + 1, pos), "
             "list_slice(nodes, pos + 2, pos - pos % 8 + 8)), '')")

ORACLES["op13_merkle_manifest"] = f"""
WITH RECURSIVE hit AS (
  SELECT *, {_CRC.format(bytes="list_transform(range(1, strlen(doc_id::VARCHAR) + 1), "
                                "lambda i: CAST(ascii((doc_id::VARCHAR)[i]) AS BIGINT))")} % 3 = 0 AS hit
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256({_LEAF} || {_FIELD.format(c="text")}) AS leaf,
         CASE WHEN hit THEN sha256({_LEAF} || {_FIELD.format(c=f"translate(text, '{_AZ}', '{_AZ.lower()}')")})
              ELSE sha256({_LEAF} || {_FIELD.format(c="text")}) END AS used,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos
  FROM hit),
levels(lang, level, nodes) AS (
  SELECT lang, 0, list(leaf ORDER BY pos) FROM leaves GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, (len(nodes) + 7) // 8), lambda i: {_RUN})
  FROM levels WHERE len(nodes) > 1),
subroots AS (
  SELECT lang, level AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place
  FROM levels WHERE len(nodes) = 1),
tops(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY place) FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, (len(nodes) + 7) // 8), lambda i: {_RUN}) FROM tops WHERE len(nodes) > 1),
steps AS (
  SELECT lang, FALSE AS top, level, nodes, NULL AS place FROM levels WHERE len(nodes) > 1
  UNION ALL SELECT lang, FALSE, height, NULL, place FROM subroots
  UNION ALL SELECT NULL, TRUE, level, nodes, NULL FROM tops WHERE len(nodes) > 1),
rising(doc_id, lang, top, level, pos, proof, folded) AS (
  SELECT doc_id, lang, FALSE, 0, pos, '', used FROM leaves
  UNION ALL
  SELECT r.doc_id, r.lang, r.top OR place IS NOT NULL, CASE WHEN place IS NULL THEN r.level + 1 ELSE 0 END,
         coalesce(place, pos // 8), CASE WHEN place IS NULL THEN proof || {_SIBLINGS} ELSE proof END,
         CASE WHEN place IS NULL THEN sha256(
           array_to_string(list_slice(nodes, pos - pos % 8 + 1, pos), '') || folded
           || array_to_string(list_slice(nodes, pos + 2, pos - pos % 8 + 8), '')) ELSE folded END
  FROM rising r JOIN steps s ON s.top = r.top AND s.level = r.level AND (r.top OR s.lang IS NOT DISTINCT FROM r.lang))
SELECT leaves.doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM leaves JOIN subroots ON subroots.lang IS NOT DISTINCT FROM leaves.lang
JOIN rising ON rising.doc_id = leaves.doc_id AND rising.top
JOIN (SELECT level AS last, nodes[1] AS root FROM tops WHERE len(nodes) = 1) ON rising.level = last
"""
