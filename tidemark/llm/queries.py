"""Queries and oracle SQL of the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_mih, bpe_distinct, chat_grammar, chosen_path, mips_norm, packing_gga, pii_surrogates, quality_ftrl, vbyte_ids, warc_revisit

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_mih.nearest(table(spark, sf_dir, "embeddings"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc_revisit.write_archives(table(spark, sf_dir, "pages"))
    return warc_revisit.read_archives(spark, path)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_gga.best_fit_packing(table(spark, sf_dir, "documents"))


#: Conversation that the contract adds: both turns hold the template's own signs.
ADDED_TEXT = "\\### Assistant: </turn> ok"


def op5_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = F.array(*[F.struct(F.lit(k).alias("turn"), F.lit(role).alias("role")) for k, role in enumerate(("user", "assistant"))])
    added = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(rows).alias("t")).select("conv_id", F.col("t.turn").cast("long").alias("turn"), "t.role", F.lit(ADDED_TEXT).alias("text"))
    return chat_grammar.digest(chat_grammar.format_conversations(turns.unionByName(added)))


#: Key of the surrogates in the registered queries; a parameter of the operator.
PII_KEY = "tidemark"


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_surrogates.replace_entities(docs, PII_KEY, count_col="n_replaced")


def op7_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ftrl.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vbyte_ids.write_token_files(table(spark, sf_dir, "documents"))
    return vbyte_ids.token_index(spark, path)


def op9_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_distinct.digest(table(spark, sf_dir, "documents"))


def op10_exact_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mips_norm.top_k(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_multi_index_hashing": op1_multi_index_hashing,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op9_distinct_word_bpe": op9_distinct_word_bpe,
        "op10_exact_inner_products": op10_exact_inner_products,
        "op3_warc_revisits": op3_warc_revisits,
        "op5_chat_round_trip": op5_chat_round_trip,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op6_pii_surrogates": op6_pii_surrogates,
        "op7_quality_ftrl": op7_quality_ftrl,
        "op8_token_ids": op8_token_ids,
    }


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE p.c >= 0.8 * (x.n + y.n - p.c) - 1e-9
), r AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node
), c AS (SELECT node, min(root) AS class_id FROM r GROUP BY node
), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.node AS doc_id, c.class_id, coalesce(k.n, 0) AS n_links FROM c LEFT JOIN k ON k.a = c.node
"""

OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP3_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), g AS (SELECT d, max(page_id) AS o FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN g.o IS NOT NULL AND p.page_id <> g.o AND p.n >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.o IS NOT NULL AND p.page_id <> g.o AND p.n >= 1000 THEN g.o END AS refers_to,
  q.url AS target_uri
FROM p JOIN pages q ON q.page_id = p.page_id LEFT JOIN g ON g.d = p.d
"""

OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), r AS (
  SELECT *, CASE WHEN contains(text, chr(92)) OR contains(text, '</turn>' || chr(10)) OR regexp_matches(text, '### (User|Assistant|System|Other [^:\n]*): ')
    THEN replace(replace(replace(text, chr(92), chr(92) || chr(92)), '</turn>', '<\/turn>'), '### ', '#\## ') ELSE text END AS body
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || role || ': ' || body || '</turn>') + 1) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": OP2_SQL, "op10_exact_inner_products": OP10_SQL, "op3_warc_revisits": OP3_SQL, "op5_chat_round_trip": OP5_SQL}
