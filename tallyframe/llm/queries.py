"""The registered queries of this subpackage and their SQL.

Every query applies its operator with production parameters to a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._common import table
from .decontam import contamination
from .mixing import mix_digest
from .quality import quality_scores
from .sharding import shard_rows
from .simhash import near_duplicates
from .token_counts import token_counts
from .token_store import token_digest
from .topk import top_products
from .toxicity import toxicity_scores
from .url_filter import judge

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(table(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), limit=2048)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op6_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)


def op8_shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), shards=40)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (op1_mix_sources, op2_token_store, op3_token_counts, op4_toxicity, op5_quality, op6_top_products, op7_decontamination, op8_shard_rows, op9_simhash, op10_url_filter)
}

ORACLE_SQL: dict[str, str] = {
    "op6_top_products": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
        r AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
          FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op7_decontamination": r"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents),
        i AS (
          SELECT CAST(item_id AS VARCHAR) AS item_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM benchmark),
        iw AS (
          SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS s
          FROM i, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS t(k) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM iw),
        dw AS (
          SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS s
          FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(k)),
        m AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (n, s)),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(k, k + n)) AS t(p) GROUP BY doc_id),
        o AS (SELECT doc_id, item_id FROM m GROUP BY doc_id, item_id),
        g AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM o GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)
    """,
}
