"""A keyed table kept as a log of runs (ST2, A12).

Each version appends one run with the rows that changed, so what a batch writes
follows the batch and not the table.  When ``fan`` runs of a level have gathered,
they are merged into one run of the next level; a row is rewritten once a level, that
is log(batches) to the base ``fan`` times in all.  A run is cut into buckets by a
hash of the key, so a lookup reads the buckets of its keys alone.

A manifest names the runs of each version.  A version is there when its manifest is;
a batch that is run again starts from the manifest before it and overwrites its own
runs.  Runs that neither the last version nor the one before it names are deleted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from skein.streaming.files import delete, exists, names

FAN = 8
BUCKETS = 16
_BUCKET = "_bucket"

Merge = Callable[[DataFrame], DataFrame]


def totals(keys: Sequence[str], *columns: str) -> Merge:
    """Rows of a key are added up."""
    return lambda rows: rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in columns))


def latest(keys: Sequence[str], columns: Sequence[str], order: str) -> Merge:
    """The row of a key with the highest ``order`` stands."""
    def merge(rows: DataFrame) -> DataFrame:
        best = F.max_by(F.struct(order, *columns), order).alias("_v")
        return rows.groupBy(*keys).agg(best).select(*keys, "_v.*")
    return merge


class KeyedLog:
    """A table of ``schema`` below ``path`` with ``keys``; ``merge`` makes one row per
    key of several runs' rows and must not depend on their order."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], merge: Merge,
                 fan: int = FAN, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.merge = spark, path, schema, list(keys), merge
        self.fan, self.buckets = fan, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest/v={version}"

    def runs(self, version: int) -> list[tuple[int, str]]:
        """(level, name) of the runs of a version; none before the first."""
        if version < 0:
            return []
        rows = self.spark.read.schema("level int, name string").json(self._manifest(version)).collect()
        return sorted((r.level, r.name) for r in rows)

    def last_version(self) -> int:
        """The last version whose manifest is complete, -1 if there is none."""
        found = [int(n[2:]) for n in names(self.spark, f"{self.path}/manifest") if n.startswith("v=")]
        return max((v for v in found if exists(self.spark, f"{self._manifest(v)}/_SUCCESS")), default=-1)

    def _rows(self, runs: Sequence[str], within: DataFrame | None = None) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        wide = StructType([*self.schema.fields, StructField(_BUCKET, IntegerType()), StructField("run", StringType())])
        rows = self.spark.read.schema(wide).option("basePath", f"{self.path}/runs") \
            .parquet(*(f"{self.path}/runs/run={r}" for r in runs))
        if within is not None:
            rows = rows.filter(F.col(_BUCKET).isin([r[0] for r in within.select(self._bucket()).distinct().collect()]))
        return rows.select(*self.schema.names)

    def read(self, version: int | None = None, keys_of: DataFrame | None = None) -> DataFrame:
        """One row per key of a version (the last one).  With ``keys_of``, only the
        buckets that its keys fall into are read; their numbers, ``buckets`` at
        most, come to the driver."""
        version = self.last_version() if version is None else version
        return self.merge(self._rows([n for _, n in self.runs(version)], keys_of))

    def _write(self, rows: DataFrame, run: str) -> None:
        rows.select(*self.schema.names, self._bucket().alias(_BUCKET)).repartition(self.buckets, _BUCKET) \
            .sortWithinPartitions(_BUCKET, *self.keys).write.mode("overwrite").partitionBy(_BUCKET) \
            .parquet(f"{self.path}/runs/run={run}")

    def append(self, changed: DataFrame, version: int) -> None:
        """Add the rows of batch ``version`` to those of version - 1."""
        before = self.runs(version - 1)
        self._write(changed, f"{version}-0")
        runs, level = [*before, (0, f"{version}-0")], 0
        while sum(at == level for at, _ in runs) >= self.fan:
            full = [n for at, n in runs if at == level]
            self._write(self.merge(self._rows(full)), f"{version}-{level + 1}")
            runs = [r for r in runs if r[0] != level] + [(level + 1, f"{version}-{level + 1}")]
            level += 1
        self.spark.createDataFrame(runs, "level int, name string").coalesce(1) \
            .write.mode("overwrite").json(self._manifest(version))
        live = {f"run={n}" for _, n in [*runs, *before]}
        for folder in set(names(self.spark, f"{self.path}/runs")) - live:
            delete(self.spark, f"{self.path}/runs/{folder}")
        if version >= 2:
            delete(self.spark, self._manifest(version - 2))
