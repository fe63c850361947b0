"""The embedding table as a bucketed table (S3-S5, JN1, JN6, JN7).

The cache is written in buckets of the sequence, sorted inside them, so a lookup or
an anti-join moves only the sequences that ask: the cache side is read where it
lies, without an exchange.  What asks is made distinct first, so a sequence that a
third of all rows name is one row here; the wanted vectors are then joined to the
rows by ``attach_pair_vectors``, whose joins can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import embed as E

BUCKETS = 64
SCHEMA = "seq string, embedding array<float>"


def open_cache(spark: SparkSession, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The cache at ``path`` as table ``name`` of the session's catalog; an empty one
    is made if there is none.  A session without a lasting catalog opens it anew by
    the same path and number of buckets."""
    if not spark.catalog.tableExists(name):
        spark.sql(f"create table `{name}` ({SCHEMA}) using parquet clustered by (seq) sorted by (seq) "
                  f"into {int(buckets)} buckets location '{path}'")
    spark.catalog.refreshTable(name)
    return spark.table(name)


def append_to_cache(new: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Add vectors; one file a bucket.  ``new`` must hold sequences that the cache
    lacks (see :func:`uncached`)."""
    open_cache(new.sparkSession, name, path, buckets)
    new.select("seq", "embedding").repartition(buckets, "seq").write.format("parquet").mode("append") \
        .bucketBy(buckets, "seq").sortBy("seq").option("path", path).saveAsTable(name)
    return open_cache(new.sparkSession, name, path, buckets)


def _asked(seqs: DataFrame, key: str) -> DataFrame:
    return seqs.select(F.col(key).alias("seq")).filter(F.length("seq") > 0).distinct()


def uncached(seqs: DataFrame, cache: DataFrame, key: str = "seq") -> DataFrame:
    """JN6: the distinct sequences, neither null nor empty, that the cache lacks."""
    return _asked(seqs, key).join(cache.select("seq").hint("merge"), "seq", "left_anti")


def cached_vectors(seqs: DataFrame, cache: DataFrame, key: str = "seq") -> DataFrame:
    """JN1: (seq, embedding) of the distinct sequences that the cache holds."""
    return _asked(seqs, key).join(cache.hint("merge"), "seq")


def embed_into(seqs: DataFrame, name: str, path: str, key: str = "seq", embedder=E.ColumnEmbedder(),
               buckets: int = BUCKETS) -> DataFrame:
    """S5, JN7: compute what the cache lacks, append it, and return the cache."""
    cache = open_cache(seqs.sparkSession, name, path, buckets)
    return append_to_cache(embedder.apply(uncached(seqs, cache, key), "seq"), name, path, buckets)


