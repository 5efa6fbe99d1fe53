"""Delimited and spreadsheet sources, read through Spark so that any file system works."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

SEPARATORS = (",", ";", "\t", "|")


def _separator(header: str) -> str:
    for sep in SEPARATORS:
        if len(next(csv.reader([header], delimiter=sep))) > 1:
            return sep
    try:
        found = csv.Sniffer().sniff(header).delimiter
    except csv.Error:
        return ","
    return found if len(found) == 1 and not found.isalnum() else ","


def _broken_lines(lines: DataFrame) -> bool:
    """Whether a quoted field holds a line end: then some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return bool(lines.where(quotes % 2 == 1).head(1))


def read_table(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Rows of a CSV (its separator is taken from the header line) or Excel file, every column text.

    ``_ord`` is the place of a row in the source (file, place of its part in the file, place in the part), for operators that keep a first or last row.
    Quoted fields may hold line ends; such a file is read by one task, so it is looked for them first unless ``multi_line`` says what is so.
    """
    if path.lower().endswith((".xlsx", ".xls")):
        import pandas as pd

        raw = spark.sparkContext.binaryFiles(path).first()[1]  # spreadsheets are small
        frame = pd.read_excel(__import__("io").BytesIO(raw), dtype=str)
        out = spark.createDataFrame(frame.where(frame.notna(), None).values.tolist(), StructType([StructField(str(c), StringType()) for c in frame.columns]))
    else:
        lines = spark.read.text(path)
        first = lines.head(1)
        header = first[0][0].lstrip("﻿") if first else ""
        multi_line = _broken_lines(lines) if multi_line is None else multi_line
        out = spark.read.csv(path, header=True, sep=_separator(header), encoding="UTF-8", quote='"', escape='"', multiLine=multi_line, inferSchema=False)
        return out.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row")).alias("_ord"))
    return out.withColumn("_ord", F.struct(F.lit(path).alias("file"), F.lit(0).cast("long").alias("part"), F.monotonically_increasing_id().alias("row")))
