"""Queries of the operators over whole tables, in production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, cws, packing, prefix_trie, quality, rules, simhash, substring_dedup, token_counts, token_files, toxicity, url_filter, vector_codes
from graphloom.llm.shared import fresh_path, spread

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.bpe_encode(spread(documents(spark, sf_dir)), TOKENIZER)
    texts = bpe.bpe_decode(tokens, TOKENIZER)
    n = (F.length("ids") / 4).cast("long")
    return texts.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(spread(documents(spark, sf_dir)))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spread(documents(spark, sf_dir)), TOKENIZER)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    weights = quality.fit(docs, labels(spark, sf_dir))
    rows = quality.quality_scores(spread(docs), weights)
    return rows.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = toxicity.fit(docs, labels(spark, sf_dir))
    rows = toxicity.toxicity_scores(spread(docs), machine)
    return rows.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.quality_rules(spread(documents(spark, sf_dir)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    token_files.write_token_files(documents(spark, sf_dir), path, TOKENIZER)
    rows = token_files.read_token_files(spark, path)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.token_counts(spread(documents(spark, sf_dir)), TOKENIZER)
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cws.fingerprint_documents(documents(spark, sf_dir))
    return rows.select("doc_id", "n_chars", "edited_sha256", cws.as_text(F.col("signature")).alias("fingerprint"), cws.as_text(F.col("edited_signature")).alias("edited_fingerprint"), "near_edited", "near_next")


#: The verdicts of op11_urls by host and path.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed URLs are those of pages on hosts with the label spam-farm."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules_ = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    listed = pages.where(F.concat(F.lit("."), url_filter.host_and_path(F.col("url"))[0], F.lit(".")).contains(".spam-farm."))
    return url_filter.judge_urls(pages, rules_, listed)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_simhash, op3_pack, op4_quality, op5_toxicity, op6_substrings, op7_rules, op8_token_files, op9_token_counts, op10_fingerprints, op11_urls, op12_prefix_trie, op13_vector_codes)}

_CRC32 = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(c) AS BIGINT) for c in string_split(CAST({0} AS VARCHAR), '')]), lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"


def _vector_sql(rounds: int = vector_codes.ROUNDS, entries: int = vector_codes.ENTRIES) -> str:
    """All rounds of op13 one after the other. Distances are sums of products of whole numbers under 2^53, so doubles hold them."""
    near = """b{i} AS MATERIALIZED (
  SELECT vec_id, p, part, min(CAST(list_inner_product(part, part) - 2 * list_inner_product(part, c) + list_inner_product(c, c) AS BIGINT) * 256 + e) AS best
  FROM parts JOIN c{i} USING (p) GROUP BY vec_id, p, part)"""
    step = """m{i} AS (
  SELECT p, e, list(CAST(floor(s / n) AS DOUBLE) ORDER BY j) AS c
  FROM (SELECT p, best % 256 AS e, j, sum(part[j]) AS s, count(*) AS n FROM b{i}, (SELECT unnest(range(1, (SELECT max(len(part)) FROM parts) + 1)) AS j) GROUP BY ALL) GROUP BY p, e),
c{k} AS MATERIALIZED (SELECT p, e, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (p, e))"""
    ctes = [
        "k AS (SELECT vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS part FROM k, (SELECT unnest([0, 1, 2, 3]) AS p))",
        f"c0 AS MATERIALIZED (SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) AS BIGINT) - 1 AS e, part AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries}))",
    ]
    for i in range(rounds):
        ctes += [near.format(i=i), step.format(i=i, k=i + 1)]
    ctes += [near.format(i=rounds), f"book AS (SELECT sha256(string_agg(array_to_string([CAST(x AS BIGINT) for x in c], ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})"]
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM (SELECT vec_id, string_agg(lpad(lower(hex(best % 256)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM b{rounds} GROUP BY vec_id)
JOIN k USING (vec_id), book"""


ORACLE_SQL = {
    "op6_substrings": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (
  SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS w
  FROM (SELECT doc_id, h, unnest(generate_series(1, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)
),
f AS (SELECT w, min(doc_id) AS first FROM p GROUP BY w),
hit AS (SELECT p.doc_id, i FROM p JOIN f USING (w) WHERE first < p.doc_id),
mark AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
run AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM mark),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, run),
piece AS (
  SELECT d.doc_id, a, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY d.doc_id ORDER BY a), 1) - 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY d.doc_id ORDER BY a), 1))) AS kept
  FROM d JOIN span USING (doc_id)
  UNION ALL
  SELECT d.doc_id, length(h), substr(h, 2 * coalesce(e, 1) - 1)
  FROM d LEFT JOIN (SELECT doc_id, max(b) AS e FROM span GROUP BY doc_id) USING (doc_id)
),
whole AS (SELECT doc_id, string_agg(kept, '' ORDER BY a) AS kept FROM piece GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d JOIN whole USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op7_rules": r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
gram AS (
  SELECT doc_id, i, words[i:i + 4] AS five
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w WHERE len(words) >= 5)
),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM gram),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i, unnest([0, 1, 2, 3, 4]) AS k FROM twice WHERE n > 1) GROUP BY doc_id
),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
base AS (
  SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)
),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
host AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS f FROM failed GROUP BY source),
total AS (SELECT sum(n) AS n, sum(f) AS f, count(*) AS k, sum(f * f * 1.0 / n) AS ff FROM host),
rate AS (SELECT f * 1.0 / n AS m, k * 1.0 / n AS o, ff / n AS q FROM total),
rho AS (
  SELECT m, CASE WHEN m <= 0 OR m >= 1 OR o >= 1 THEN 0.5
    ELSE least(greatest(((q - m * m) / (m * (1 - m)) - o) / (1 - o), 0.0001), 0.999) END AS r FROM rate
),
verdict AS (SELECT source, (f + m * (1 / r - 1)) / (n + (1 / r - 1)) <= 0.5 AS host_kept FROM host, rho)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM failed JOIN verdict ON failed.source IS NOT DISTINCT FROM verdict.source
""",
    "op11_urls": r"""
WITH r(rule_host, rule_path, rule_verdict) AS (VALUES __RULES__),
t AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM t
),
n AS (SELECT *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') AS plain FROM u),
spam AS (SELECT DISTINCT plain FROM n WHERE contains('.' || host || '.', '.spam-farm.')),
best AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM n JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(best.verdict, CASE WHEN n.plain IN (SELECT plain FROM spam) THEN 'block' ELSE 'allow' END) AS verdict
FROM n LEFT JOIN best USING (page_id)
""".replace("__RULES__", ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)),
    "op12_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x
  FROM conversations
),
l AS (SELECT conv_id, list(x ORDER BY i) AS xs FROM t GROUP BY conv_id),
h AS (SELECT conv_id, xs, conv_id - conv_id % 20 AS base, __CRC__ % 4 AS h FROM l),
c AS (SELECT h.conv_id, list_concat(coalesce(b.xs[1:h], []), h.xs[h + 1:]) AS xs FROM h LEFT JOIN l AS b ON b.conv_id = h.base),
p AS (SELECT conv_id, len(xs) = d AS at_end, d, xs[1:d] AS k, CASE WHEN d > 0 THEN xs[1:d - 1] END AS up FROM (SELECT conv_id, xs, unnest(range(len(xs) + 1)) AS d FROM c)),
n AS (
  SELECT k, any_value(up) AS up, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (at_end), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d].t, '[^\x20\x09-\x0D]+')) END AS words
  FROM p GROUP BY k, d
),
kids AS (SELECT up AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
full_nodes AS (
  SELECT n.*, m.conv_id AS parent_conv_id, coalesce(n_children, 0) AS n_children
  FROM n LEFT JOIN n AS m ON m.k = n.up AND n.depth > 0 LEFT JOIN kids ON kids.k = n.k
),
above AS (SELECT k[1:j] AS k, n_children, (n_convs - 1) * words AS saved FROM (SELECT *, unnest(range(depth + 1)) AS j FROM full_nodes)),
sums AS (SELECT k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY k)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM full_nodes JOIN sums USING (k)
""".replace("__CRC__", _CRC32.format("conv_id")),
    "op13_vector_codes": _vector_sql(),
}
