"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; in local mode a folder is made and set where none is."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def materialise(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and read them from there.

    This cuts the lineage, survives lost executors, and gives later joins a known size.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialise() wrote; for tables that nothing reads any more, as those of earlier rounds of a loop."""
    for df in tables:
        path = getattr(df, "_table", None)
        if path:
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with column ``name``: 1, 2, ... in the given order.

    The rows are sorted by ranges and counted by partition, so no task sees more than a partition; the counts (a row for each partition) are summed
    and broadcast.
    """
    placed = materialise(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, (F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1).cast("long")).drop("_at", "_part", "_before")


def running(df: DataFrame, group: list[str], order: list, sums: dict[str, Column | str], few: int = 200_000) -> DataFrame:
    """``df`` with, for each entry of ``sums``, the sum of that value over the rows before in the group (``name``) and over the whole group (``name_total``).

    Groups, of columns without nulls, may be of any size: rows are sorted by ranges, so a large group lies in many partitions, and what earlier partitions hold of a
    group is carried on (a row for each partition and group). At most ``few`` rows in all, which are counted, take one window instead.
    The order should be total; rows that tie keep one order throughout.
    """
    if df.limit(few + 1).count() <= few:
        whole = Window.partitionBy(*group)
        earlier = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        own = {k: F.col(c) if isinstance(c, str) else c for k, c in sums.items()}
        return df.select("*", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(k) for k, c in own.items()), *(F.sum(c).over(whole).alias(f"{k}_total") for k, c in own.items()))
    values = {f"_v{i}": (F.col(c) if isinstance(c, str) else c) for i, c in enumerate(sums.values())}
    placed = materialise(df.withColumns(values).orderBy(*group, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    held = placed.groupBy(part.alias("_part"), *group).agg(*(F.sum(v).alias(f"{v}s") for v in values))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select("_part", *group, *(F.coalesce(F.sum(f"{v}s").over(earlier), F.lit(0)).alias(f"{v}b") for v in values), *(F.sum(f"{v}s").over(whole).alias(f"{v}t") for v in values))
    inside = Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("_part", part).withColumns({f"{v}i": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).join(carried, ["_part", *group])
    out = rows.withColumns({name: F.col(f"{v}i") + F.col(f"{v}b") for name, v in zip(sums, values, strict=True)}).withColumnsRenamed({f"{v}t": f"{name}_total" for name, v in zip(sums, values, strict=True)})
    return out.drop("_at", "_part", *(x for v in values for x in (v, f"{v}i", f"{v}b")))


#: Rows of one 8-byte key that may be broadcast: 4 MB.
BROADCAST_ROWS = 500_000


def keyed_join(left: DataFrame, keys: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Join ``left`` with ``keys`` (materialised, a few bytes a row) from the left; broadcast only after counting it."""
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    return left.join(keys, column, how)
