"""A corpus from raw documents: five stages, in order, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a table. All but the last return the columns of ``docs``,
whatever these are: the operators' columns never meet them. Rows here are whole texts, and Python workers live on
from stage to stage beside a heap that has grown: stages run in small Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtable.llm import mixing, packing, pii, simhash, toxicity
from logtable.llm.rows import free_name, numbered
from logtable.session import shared_dir, small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage, in a session with ``small_batches``: what it returns is run later."""

    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return bounded


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents predicted toxic, by labels that are not held out. No row is moved.

    Null texts, empty texts and repeated rows stay; without labels every document stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.without_toxic(docs, model)


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class: that of the smallest id (a null id is the largest).

    Repeated rows are copies. Texts without words are one class.
    """
    fp = free_name(docs, "fp")
    rows = numbered(simhash.fingerprinted(docs, fp), "dedup")
    row = rows.columns[0]
    narrow = rows.select(F.col(fp).alias("fp"), F.col("doc_id").alias("doc_id"), F.col(row).alias("row"))
    classes = simhash.classes(narrow.select("fp", "doc_id"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    # the first of each fingerprint, then the first of each class; a class is named by its smallest fingerprint
    first = narrow.groupBy("fp").agg(F.min(order).alias("first")).join(classes, "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = first.select(F.col("first.row").alias(row))
    return rows.join(kept, row, "left_semi").select(docs.columns)


@in_small_batches
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by the names of its kinds. Every row stays."""
    return pii.redacted(docs, pii.fit(docs))


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources come near their target weights.

    A document without words has nothing to weigh and stays once.
    """
    rows = numbered(docs, "mix")
    row = rows.columns[0]
    sized = rows.select(F.col(row).alias("row_key"), "source", mixing.word_count(F.col("text")).alias("size"))
    taken = mixing.mix(sized).select(
        F.col("row_key").alias(row), F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).alias("copies")
    )
    # a row of the narrow side per copy, so the texts take part in a plain equality join
    copies = taken.filter("copies > 0").select(row, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return rows.join(copies.select(row), row).select(docs.columns)


@in_small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token pieces, ids included, with their places in sequences of 1024 tokens."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL: learned models decide in two stages, and XXH64 and token ids are beyond it. tests/llm compares the
#: stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
