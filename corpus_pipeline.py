"""Corpus pipeline: quality, near duplicates, decontamination, secrets, packing.

Each stage takes the documents that the stage before kept, and gives the columns of ``documents`` (the last one the
pieces of the packed sequences). Tables other than documents are read from ``sf_dir``.

Decisions are about rows: a row is told apart by its id and a hash of its text, so rows that share an id, and rows without one,
are judged each by its own text.

Defined edge cases: null and empty texts are rejected or kept by the classifier like any other, have no shingles, leaks
or secrets (so all of them stay), and pack as one end id; of repeated rows with words one stays; labels are known by id only; columns whose names begin with
``__`` are the stages' own, other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm.decontam import contaminated
from ledgerloom.llm.jaccard import linked_rows, row_key
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.quality import fit_quality, with_quality
from ledgerloom.llm.queries import tokenizer_path
from ledgerloom.llm.secrets import redacted
from ledgerloom.plans.tables import discard, keyed_join, materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts 1 for."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_quality(docs, model, "__quality").where(F.col("__quality") >= 0.3).drop("__quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts: the one with the smallest id."""
    keyed = docs.withColumn("__row", row_key())
    rows = materialise(linked_rows(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("__row").alias("row"))).where("component is not null"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("x")).select("x.row")
    others = materialise(rows.select("row").distinct().join(first, "row", "left_anti").withColumnRenamed("row", "__row"))
    kept = keyed_join(keyed, others, "__row", "left_anti")
    repeated = materialise(rows.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(first, "row", "left_semi").select(F.col("row").alias("__row")))
    if repeated.limit(1).count():
        # the same id and text more than once: such rows only are shuffled
        kept = keyed_join(kept, repeated, "__row", "left_anti").union(keyed_join(kept, repeated, "__row").dropDuplicates(["__row"]))
    return kept.drop("__row")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leaked benchmark item."""
    keyed = docs.withColumn("__row", row_key())
    leaks = contaminated(keyed.select(F.col("__row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return keyed_join(keyed, materialise(leaks.select(F.col("doc_id").alias("__row")).distinct()), "__row", "left_anti").drop("__row")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret's span replaced by ``<SECRET>``; n_chars follows the text where that changed."""
    out = redacted(docs.withColumn("__whole", F.col("text")))
    length = F.when(F.col("text") == F.col("__whole"), F.col("n_chars")).when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return out.withColumn("n_chars", length).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of at most 4096 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("secrets", redact_secrets), ("packing", pack)]
#: The classifier and the tokenizer can't be said in SQL; tests/llm/test_pipeline.py compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
            discard(before)  # what the stage read is no longer needed
    return docs


QUERIES = {"pipeline": run}
