"""Intermediate tables in the shared folder, and rows dropped by id and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import scratch_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.
    Cuts the lineage, survives lost executors and tells the planner the true
    size, so small tables are broadcast by Spark's own threshold.  Shuffle files of
    the write go with its end, as nothing reads its plan again."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def freed(*tables: DataFrame) -> None:
    """Delete ``written`` tables that nothing reads any more, and let the driver collect
    its garbage: until then Spark keeps the broadcasts of the jobs that are over in the
    executors' memory."""
    spark: SparkSession = tables[0].sparkSession
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    spark._jvm.System.gc()


def text_mark(text: Column) -> Column:
    """A 64-bit hash that tells texts of one doc_id, or of none, apart."""
    return F.xxhash64(text)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id, also a null one, and text aren't in
    ``gone`` (doc_id, mark)."""
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["doc_id"])
                     & (text_mark(docs["text"]) == gone["mark"]), "left_anti")
