"""CSV whose records span lines, read by many tasks.

Spark's reader gives a file whose records hold newlines to one task.  Here files are
split at newlines wherever they lie.  A newline ends a record if an even number of
quotes stands before it in the file: each split counts its quotes, running totals over
a file's splits tell every split where it begins, and lines between two record
borders are put together again.  Headers come from the first record of each file, in
one pass, and files with the same header are parsed together.
"""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from skein.session import scratch_path

OPTIONS = {"quote": '"', "escape": '"', "mode": "FAILFAST", "multiLine": "true"}


def _running(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Sum of ``column`` over the splits of the file before a split."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.sum(column).over(before), F.lit(0)))


def records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, record, text): the records of all files, numbered from 0 in each, without
    their last line break; blank ones are left out.  Quotes stand only around fields
    and doubled inside them."""
    place = scratch_path(spark, "csv-lines")
    spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
        (F.regexp_count("value", F.lit('"')) % 2).alias("odd")).write.parquet(place)
    lines = spark.read.parquet(place)
    key = ["file", "block"]
    inside = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = _running(lines.groupBy(*key).agg(F.sum("odd").alias("odd")), "odd", "odd_before").drop("odd")
    lines = lines.join(splits, key).withColumn("start", ((
        F.col("odd_before") + F.coalesce(F.sum("odd").over(inside), F.lit(0))) % 2 == 0).cast("long"))
    marked = scratch_path(spark, "csv-marked")
    upto = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines.select(*key, "at", "value", "start", F.sum("start").over(upto).alias("nth")).write.parquet(marked)
    lines = spark.read.parquet(marked)
    splits = _running(lines.groupBy(*key).agg(F.sum("start").alias("starts")), "starts", "before").drop("starts")
    whole = lines.join(splits, key).groupBy("file", (F.col("before") + F.col("nth") - 1).alias("record")).agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("lines"))
    text = F.regexp_replace(F.array_join("lines.value", "\n"), "\r$", "")
    return whole.select("file", "record", text.alias("text")).filter("text <> ''")


def read_multiline_csv(spark: SparkSession, paths: Sequence[str]) -> list[DataFrame]:
    """One frame of strings per distinct header, its columns named by the header.

    The driver holds the headers, one a file.  A file without a record, or with a
    header alone, adds no row; a record that doesn't fit its header fails the job.
    Line breaks inside a field stay as they are in the file.
    """
    place = scratch_path(spark, "csv-records")
    records(spark, paths).write.parquet(place)
    rows = spark.read.parquet(place)
    heads = rows.groupBy("file").agg(F.min_by("text", "record").alias("header"), F.min("record").alias("first"))
    by_header: dict[str, list] = defaultdict(list)
    for r in heads.collect():
        by_header[r.header.lstrip("﻿")].append((r.file, r.first))
    out = []
    for header, files in sorted(by_header.items()):
        names = next(csv.reader([header]))
        schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
        own = spark.createDataFrame(files, "file string, first long")
        parsed = rows.join(own, "file").filter(F.col("record") > F.col("first")) \
            .select(F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), OPTIONS).alias("r"))
        out.append(parsed.select(*(F.col(f"r.c{i}").alias(n) for i, n in enumerate(names))))
    return out
