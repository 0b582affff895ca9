"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.llm.bpe import encode_documents
from crosspanel.llm.common import documents
from crosspanel.llm.fingerprints import edited_fingerprints
from crosspanel.llm.language import identify
from crosspanel.llm.negatives import mine_negatives, moved_labels
from crosspanel.llm.neighbours import nearest
from crosspanel.llm.packing import pack_documents
from crosspanel.llm.pii import pseudonymise
from crosspanel.llm.resampling import importance_resample
from crosspanel.llm.secrets import secret_digests
from crosspanel.llm.sharding import balanced_shards
from crosspanel.llm.similarity import similar_documents
from crosspanel.llm.substrings import remove_repeats
from crosspanel.llm.urls import filter_urls

#: host, path, verdict
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


#: The key of this process, where the session names none.
_OWN_KEY = token_hex(32)


def pseudonym_key(spark: SparkSession) -> str:
    """The session's secret, spark.crosspanel.pseudonymKey. Where it names none, a key is drawn at
    random that no one knows and that ends with the process: pseudonyms made under it are linked among
    each other, not with those of other runs."""
    return spark.conf.get("spark.crosspanel.pseudonymKey", None) or _OWN_KEY


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op2_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 4 == 2)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(documents(spark, sf_dir))
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return encoded.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), pseudonym_key(spark))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(documents(spark, sf_dir))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id = F.col("vec_id")
    vectors = moved_labels(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), vec_id % 7 == 0, (F.col("label") + 1) % 10)
    return mine_negatives(vectors, vectors.where(vec_id % 100 == 0))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_similar": op2_similar,
    "op3_language": op3_language,
    "op4_url_filter": op4_url_filter,
    "op5_bpe": op5_bpe,
    "op6_pii": op6_pii,
    "op7_packing": op7_packing,
    "op8_substrings": op8_substrings,
    "op9_shards": op9_shards,
    "op10_neighbours": op10_neighbours,
    "op11_negatives": op11_negatives,
    "op12_resample": op12_resample,
    "op13_secrets": op13_secrets,
}

ORACLES: dict[str, str] = {
    "op4_url_filter": r"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, position('://' IN url) + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest
), split AS (
  SELECT page_id, coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*'), '') AS path, row_number() OVER () AS rn
  FROM parts
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT rn, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM split JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY rn
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN best USING (rn)
""",
    "op11_negatives": """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS y
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.y, b.y)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
""",
    # the checksum is made from its table, one byte after the other, once for each different run of words
    "op12_resample": r"""
WITH divisor AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))
), texts AS (
  SELECT 'documents' AS side, row_number() OVER () AS rn, doc_id, text FROM documents UNION ALL SELECT 'benchmark', row_number() OVER (), item_id, text FROM benchmark
), words AS (
  SELECT side, rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), runs AS MATERIALIZED (
  SELECT side, rn, run, count(*) AS times FROM (
    SELECT side, rn, array_to_string(w[i : i + n], ' ') AS run FROM (SELECT side, rn, w, n, unnest(range(1, len(w) - n + 1)) AS i FROM words, range(3) k(n)))
  GROUP BY ALL
), bytes AS (
  SELECT run, hex(encode(run)) AS h FROM (SELECT DISTINCT run FROM runs)
), hashed AS MATERIALIZED (
  SELECT run, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT FOR i IN range(len(h) // 2)]), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, divisor
), counts AS (
  SELECT bucket, coalesce(sum(times) FILTER (side = 'documents'), 0)::DOUBLE AS s, coalesce(sum(times) FILTER (side = 'benchmark'), 0)::DOUBLE AS t FROM runs JOIN hashed USING (run) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM counts
), sums AS (
  SELECT rn, sum(times)::BIGINT AS n_features, sum(times * gain)::BIGINT AS weight FROM runs JOIN hashed USING (run) JOIN gains USING (bucket) WHERE side = 'documents' GROUP BY rn
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS may,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN sums USING (rn) WHERE side = 'documents'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id, n_features) AS place, count(*) FILTER (may) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 5 * n // 100 THEN place END AS rank FROM placed
""",
    "op13_secrets": r"""
WITH kinds(kind, pos, pattern, least, bits) AS (
  VALUES ('assign', 0, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 12, NULL), ('access', 1, 'AKIA[A-Z0-9]+', 18, NULL),
    ('hex', 2, '[0-9a-f]+', 16, NULL), ('entropy_hex', 3, '[0-9A-Fa-f]+', 24, 3.0), ('entropy_base64', 4, '[A-Za-z0-9+/_=-]+', 24, 4.0)
), rows AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents
), matches AS (
  SELECT rn, kind, pos, bits, least, m[i] AS match, CASE kind WHEN 'assign' THEN length(regexp_extract(m[i], '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) ELSE length(m[i]) END >= least AS long, i, length(gap[i]) AS gap
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rn, kinds.*, regexp_extract_all(text, pattern) AS m, string_split_regex(text, pattern) AS gap FROM rows, kinds))
), located AS (
  SELECT *, sum(gap + length(match)) OVER (PARTITION BY rn, kind ORDER BY i) - length(match) AS first FROM matches
), windows AS (
  SELECT rn, kind, pos, first, step, bits, substring(match, step + 1, 24) AS w FROM (
    SELECT *, unnest(range(length(match) - 23)) AS step FROM located
    WHERE long AND bits IS NOT NULL AND NOT regexp_matches(match, '^[A-Za-z_/+=-]+$') AND NOT regexp_matches(match, '^[0-9_/+=-]+$')
      AND NOT regexp_matches(match, '(?i)example|sample|dummy|placeholder|changeme|redacted|0123456789|abcdefghij') AND NOT regexp_matches(match, '(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$'))
), high AS (
  SELECT rn, kind, pos, first, first + step AS s FROM windows
  WHERE list_sum([round(n * log2(n) * 1048576) FOR n IN map_values(list_histogram(string_split(w, '')))]) <= floor(24 * (log2(24) - bits) * 1048576)
), merged AS (
  SELECT rn, kind, pos, min(s) AS s, max(s) + 24 AS e FROM (
    SELECT *, sum(CASE WHEN s - before <= 24 THEN 0 ELSE 1 END) OVER (PARTITION BY rn, kind, first ORDER BY s) AS part
    FROM (SELECT *, lag(s) OVER (PARTITION BY rn, kind, first ORDER BY s) AS before FROM high))
  GROUP BY rn, kind, pos, first, part
), spans AS (
  SELECT rn, kind, pos, s, e FROM merged UNION ALL SELECT rn, kind, pos, first, first + length(match) FROM located WHERE long AND bits IS NULL
)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, pos) FILTER (pos < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, pos) FILTER (kind IS NOT NULL), '') AS spans
FROM rows LEFT JOIN spans USING (rn) GROUP BY rn, doc_id
""",
}
