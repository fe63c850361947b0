"""Stream sources and sinks that keep results in the shared folder.

``run_available`` drains what is available (``availableNow``) into parquet
below a folder the caller names (or a fresh one below ``spark.checkpoint.dir``)
and returns the written table.  Running it again with the same folder continues
from the checkpoint: only new input is read.
  * append mode — the file sink (exactly-once through its commit log);
  * update mode — ``foreachBatch`` appends each batch's changed rows to a keyed
    log (``store.KeyedLog``) as the version of its batch id; the table is the latest
    row per key, and superseded runs are merged and deleted.
It returns when the input is drained or raises what stopped the query.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from skein.session import scratch_path
from skein.sources.tables import table_path
from skein.streaming.files import is_folder
from skein.streaming.store import KeyedLog, latest


def read_stream(spark: SparkSession, sf_dir: str, table: str,
                schema: StructType | None = None, files_per_trigger: int | None = None
                ) -> DataFrame:
    """Stream a table: its folder of parquet files, or one ``<table>.parquet``
    file picked out of ``sf_dir`` by ``pathGlobFilter``."""
    path = table_path(sf_dir, table)
    schema = schema or spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", path.rsplit("/", 1)[-1]).parquet(sf_dir)


def read_written(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A sink's table; empty only if no batch has made its folder.  Any other
    failure to read it is raised."""
    if not is_folder(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


class RowsLost(RuntimeError):
    pass


def finish(query, progress: list[dict] | None = None) -> None:
    """Wait for a query to drain its input.  Its progress records go to
    ``progress``; a row that an operator dropped behind the watermark is an error."""
    query.awaitTermination()
    records = query.recentProgress
    records = [json.loads(p.json) if hasattr(p, "json") else dict(p) for p in records]
    if progress is not None:
        progress += records
    lost = sum(op.get("numRowsDroppedByWatermark", 0) for p in records for op in p.get("stateOperators", ()))
    if lost:
        raise RowsLost(f"{lost} rows came behind the watermark of {query.name or query.id}")


def run_available(stream: DataFrame, name: str, mode: str = "append",
                  keys: Sequence[str] = (), base: str | None = None,
                  progress: list[dict] | None = None) -> DataFrame:
    spark = stream.sparkSession
    base = base or scratch_path(spark, name)
    data, ckpt = f"{base}/data", f"{base}/_checkpoint"
    if mode == "append":
        q = (stream.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start(data))
        finish(q, progress)
        return read_written(spark, data, stream.schema)
    if mode != "update" or not keys:
        raise ValueError("update mode needs key columns")
    cols = [c for c in stream.columns if c not in keys]
    schema = StructType([*(stream.schema[c] for c in [*keys, *cols]), StructField("_batch", LongType())])
    log = KeyedLog(spark, data, schema, keys, latest(keys, cols, "_batch"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        log.append(batch.withColumn("_batch", F.lit(batch_id).cast("long")), batch_id)

    q = (stream.writeStream.outputMode("update").foreachBatch(write_batch)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    finish(q, progress)
    return log.read().select(*stream.columns)
