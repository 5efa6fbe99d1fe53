"""Bounded samples of labelled rows on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.tables import discard, materialise
from .textbatch import fold

#: Documents of each class that a classifier is fitted on, at most about this many.
PER_CLASS = 4000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, folds: int = 5) -> DataFrame:
    """(doc_id, text, label, weight) of about ``per_class`` rows of each class, as a table.

    Rows of fold 0 are never used. A document labelled more than once takes the largest label; null
    labels and ids are skipped, and so are labels of no document. ``weight`` is the inverse of the sampling rate of the class, so
    that weighted classes keep their natural shares. The choice is by a hash of the id, hence the
    same in every run. Texts of any length are taken, whole.
    """
    rows = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != 0))
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    known = materialise(docs.select("doc_id").join(rows, "doc_id"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = {k: min(1.0, per_class / n) for k, n in sizes.items()}
    unit = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) / 1_000_000.0
    limit = F.when(F.col("label") == 1, F.lit(rate.get(1, 0.0))).otherwise(F.lit(rate.get(0, 0.0)))
    chosen = known.where(unit < limit).withColumn("weight", F.try_divide(F.lit(1.0), limit)).distinct()
    # about 2 * per_class rows of three small columns, whatever the size of the tables
    out = materialise(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    discard(known)
    return out
