"""The queries of this folder, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language, minhash, packing, shards, sketch, token_files, tokens, toxicity, urls
from .common import fresh, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) < 3 THEN list_distinct([array_to_string(ws, ' ')])[1:len(ws)]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END sh FROM w
), x AS MATERIALIZED (SELECT doc_id, unnest(sh) g, len(sh) n FROM s),
p AS MATERIALIZED (
  SELECT a.doc_id a, b.doc_id b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id node, doc_id label FROM documents UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node WHERE r.label < e.b),
c AS (SELECT node, min(label) label FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) n_shingles, c.label component_id, s.doc_id = c.label kept FROM s JOIN c ON c.node = s.doc_id
"""


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), fresh(spark, "token-files")
    token_files.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.checksums(token_files.read_token_files(spark, path, columns=("doc_id", "start", "n_tokens", "ids")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ARRIVALS = 4


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the committed version, after all arrivals and the compaction.  Every row is dealt
    to an arrival, one without an id to the first; the column is the remainder as SQL has it."""
    docs, root = table(spark, sf_dir, "documents"), fresh(spark, "shards")
    store = shards.ShardSet(spark, root)
    for k in range(ARRIVALS):
        due = F.coalesce(F.pmod("doc_id", F.lit(ARRIVALS)), F.lit(0)) == k
        store.append(docs.where(due).withColumn("arrival", (F.col("doc_id") % ARRIVALS).cast("int")))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "arrival", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP7_SQL = """
SELECT doc_id, CAST(doc_id % 4 AS INTEGER) AS arrival, lang, source, sha256(coalesce(text, '')) AS text_sha256 FROM documents
"""


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.judge(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, fresh(spark, "digest-index"))
    return exact_dedup.dedup(table(spark, sf_dir, "documents"), index).drop("row_no")


OP9_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Query]:
    return {
        "op1_minhash": op1_minhash,
        "op2_bpe_codec": op2_bpe_codec,
        "op3_token_files": op3_token_files,
        "op4_url_filter": op4_url_filter,
        "op5_fingerprints": op5_fingerprints,
        "op6_toxicity": op6_toxicity,
        "op7_sharding": op7_sharding,
        "op8_language": op8_language,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": OP1_SQL, "op7_sharding": OP7_SQL, "op9_exact_dedup": OP9_SQL}
