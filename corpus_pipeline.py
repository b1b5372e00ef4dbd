"""From raw documents to token files: five stages, each over all rows that the one before kept.

Part of the subpackage tallyframe.llm. Each stage takes (spark, docs, sf_dir); all but the last
return the columns of documents, whatever else they are called: helper columns take clear names.

Rules of all stages: a null text is an empty one, and a text of any length is read whole. Rows are
told apart by (doc_id, text), so null, tied and repeated doc_ids do no harm; verdicts on equal texts
are equal. An empty table gives an empty result, and so do empty labels or an empty benchmark reject
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm._common import clear_name, staged, table, uniform, with_small
from tallyframe.llm.decontam import contamination
from tallyframe.llm.mixing import mix
from tallyframe.llm.near_copies import keep_one
from tallyframe.llm.queries import tokenizer_path
from tallyframe.llm.simhash import SENT_ROWS
from tallyframe.llm.token_store import token_digest
from tallyframe.llm.toxicity import scored, train

TOXIC = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the toxicity classifier rejects go; null and empty texts are clean. All other rows stay, repeated ones too."""
    machine = train(docs, table(spark, sf_dir, "labels"), threshold=TOXIC)
    score = clear_name(docs.columns, "toxic_score")
    return scored(docs, machine, score).filter(F.col(score) < TOXIC).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word similarity 0.8 or more) stays: that of the smallest (doc_id, text hash).

    Texts without words, null ones among them, are copies of each other. Of rows equal in doc_id and text one stays.
    """
    return keep_one(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows contaminated by benchmark passages go; equal texts share a verdict, so a hash of the text names them.

    Texts without words, null ones among them, stay, as do repeated rows.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    marks = contamination(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    name = clear_name(docs.columns, "text_hash")
    bad = staged(marks.filter("contaminated").select(F.col("doc_id").alias(name)).distinct(), "pipeline-contaminated")
    return docs.withColumn(name, key).join(bad, name, "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them: 0 to 3 times, the fraction by chance of a fixed hash.

    A null source is a source; rows without words (null, empty or blank texts) are never taken. Rows equal in
    doc_id, source and text are taken equally often, by what the mix takes of all of them.
    """
    key = F.xxhash64("doc_id", "source", F.coalesce("text", F.lit("")))
    taken = mix(docs.select(key.alias("doc_id"), "source", "text")).taken.filter("taken > 0 or size > 0")
    per = taken.groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    name, copies = clear_name(docs.columns, "row_hash"), clear_name(docs.columns, "copies")
    # `size` and `taken` sum over the equal rows of a key, so they share what they were taken.
    times = F.floor(F.col("taken") / F.col("size") + uniform("doc_id", F.lit(29))).cast("int")
    per = staged(per.select(F.col("doc_id").alias(name), times.alias(copies)).filter(F.col(copies) > 0), "pipeline-copies")
    mixed = with_small(docs.withColumn(name, key), per, name, per.count(), most=SENT_ROWS)
    nth = clear_name([*docs.columns, name, copies], "nth")
    return mixed.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in doc_id order, null last, read back: doc_id, start, n_tokens, ids_crc32. Null and empty texts hold the end id alone; every row keeps its place."""
    return token_digest(docs, tokenizer_path(), end_id=1)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: A trained classifier and seeded draws decide, which SQL cannot state; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
