"""Load prompt tables from CSV or parquet and union them by name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.schemas import PROMPT_SCHEMA
from skein.sources.csv import read_multiline_csv


def read_prompt_csv(spark: SparkSession, paths: str | Sequence[str],
                    schema: StructType = PROMPT_SCHEMA) -> DataFrame:
    """Read prompt CSV files; columns are matched by header name.

    Every field is a string (nothing is inferred); the known columns are cast to
    ``schema``'s types by name and files are unioned by name, as a header-aligned
    concat does.  Prompts hold newlines, so records may span lines; files are split
    all the same (``csv.read_multiline_csv``).
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    types = {f.name: f.dataType for f in schema.fields}
    return union_by_name([raw.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`")
                                       for c in raw.columns]) for raw in read_multiline_csv(spark, paths)])


def read_prompt_files(spark: SparkSession, paths: Sequence[str],
                      schema: StructType = PROMPT_SCHEMA) -> DataFrame:
    """Read a mix of ``.csv`` and parquet paths, aligned by column name."""
    csv = [p for p in paths if p.lower().endswith(".csv")]
    other = [p for p in paths if not p.lower().endswith(".csv")]
    parts = []
    if csv:
        parts.append(read_prompt_csv(spark, csv, schema))
    if other:
        parts.append(spark.read.parquet(*other))
    return union_by_name(parts)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL aligned by column name; missing columns become null."""
    if not frames:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_cycles(spark: SparkSession, paths_by_cycle: dict[int, str],
                schema: StructType) -> DataFrame:
    """The design-cycle CSVs read in one scan, ``cycle`` from the file's or
    its folder's full path.  A file that matches none of the paths is an error."""
    paths = list(paths_by_cycle.values())
    df = (spark.read.schema(schema).option("header", True).csv(paths)
          .withColumn("_file", F.input_file_name()))
    # full paths: files may have the same name in several folders
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    own = F.url_decode(F.replace(F.parse_url("_file", F.lit("PATH")), F.lit("+"), F.lit("%2B")))
    cycle = None
    for c, p in paths_by_cycle.items():
        path = jvm.org.apache.hadoop.fs.Path(p)
        want = path.getFileSystem(conf).makeQualified(path).toUri().getPath().rstrip("/")
        hit = (own == want) | own.startswith(want + "/")
        cycle = F.when(hit, F.lit(c)) if cycle is None else cycle.when(hit, F.lit(c))
    cycle = cycle.otherwise(F.raise_error(F.concat(F.lit("no cycle for file "), F.col("_file"))).cast("int"))
    return df.withColumn("cycle", cycle).drop("_file")
