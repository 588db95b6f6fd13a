"""The registered queries of the corpus operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, jaccard, line_dedup, packing, pii, prefix_trie, quality, repair, token_counts, topk, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest neighbours found for every twentieth vector."""
    return ann.nearest(_read(spark, sf_dir, "embeddings"))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under its language's trusted text, and whether it is kept."""
    return quality.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 1024 tokens."""
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document."""
    out = pii.find(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation in every participant's perspective."""
    return chat.rotate(_read(spark, sf_dir, "conversations"))


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and after dropping repeated ones, and the hash of what stays."""
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document and its number of links."""
    return jaccard.jaccard_join(_read(spark, sf_dir, "documents"))


def op9_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products for every twentieth vector."""
    return topk.exact_top_k(_read(spark, sf_dir, "embeddings"))


def op10_hof_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and what they decode to, as hashes."""
    out = bpe.encode(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_role_earley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations: their faults, the cheapest repair, its edits and the hash of what they make of it."""
    turns = _read(spark, sf_dir, "conversations")
    facts, edits = repair.repair(repair.damage(turns))
    found = facts.withColumnRenamed("conv_id", "c").join(repair.digests(edits).withColumnRenamed("conv_id", "c2"), F.col("c").eqNullSafe(F.col("c2")))
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op12_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by rules, else by its host's reputation: a page's outcome is the label of the document of its id, bad if of no quality or toxic."""
    pages, labels = _read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels")
    bad = F.when(F.col("quality").isNotNull(), ((F.col("quality") == 0) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int"))
    outcomes = pages.join(labels, pages["page_id"] == labels["doc_id"]).select("url", bad.alias("bad"))
    return url_filter.judge(pages, URL_RULES, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    nodes, _ = prefix_trie.prefix_trie(_read(spark, sf_dir, "conversations"))
    return nodes.drop("turn_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_kmeans_tree, op2_kneser_ney, op3_pattern_packing, op4_skip_chain_pii, op5_perspectives, op6_line_runs, op7_token_counts, op8_chosen_path, op9_block_topk, op10_hof_bpe, op11_role_earley, op12_host_reputation, op13_prefix_trie)
}

ORACLE_SQL: dict[str, str] = {
    "op13_prefix_trie": prefix_trie.TRIE_SQL,
    "op11_role_earley": repair.repair_sql(),
    "op12_host_reputation": url_filter.judge_sql(URL_RULES),
    "op5_perspectives": chat.ROTATE_SQL,
    "op6_line_runs": """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents
), lines AS (
  SELECT d.r, d.doc_id, u.i, d.all_lines[u.i] AS line FROM d, unnest(range(1, len(d.all_lines) + 1)) AS u(i)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3
), marked AS (
  SELECT k.r, k.doc_id, k.i, k.line, r.key IS NOT NULL AND (k.doc_id IS DISTINCT FROM r.keeper OR r.keeper IS NULL) AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
""",
    "op9_block_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""",
}
