"""One vector per new distinct sequence (JN6, S3–S5, A5).

Work is done once per *distinct* sequence that the cache lacks
(``distinct`` + ``left_anti``), then appended to the cache table.  The
embedder is a plug-in: a column expression (JVM, default one-hot
composition) or a pandas batch function run with ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.vectors import composition


@dataclass(frozen=True)
class ColumnEmbedder:
    """Embedder written as a column expression ``seq -> array<float>``."""
    fn: Callable[[Column], Column] = composition

    def apply(self, seqs: DataFrame, key: str = "seq") -> DataFrame:
        return seqs.select(key, self.fn(F.col(key)).alias("embedding"))


@dataclass(frozen=True)
class PandasEmbedder:
    """Embedder over Arrow batches: ``fn(list[str]) -> list[list[float]]``.

    Runs inside ``mapInPandas``; a model is loaded once per Python worker by
    ``fn`` itself (e.g. a module-level cache), never per row.
    """
    fn: Callable[[list[str]], list[list[float]]]

    def apply(self, seqs: DataFrame, key: str = "seq") -> DataFrame:
        fn = self.fn

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                vecs = fn(pdf[key].tolist())
                yield pd.DataFrame({key: pdf[key], "embedding": vecs})

        return seqs.select(key).mapInPandas(run, f"{key} string, embedding array<float>")


def new_sequences(seqs: DataFrame, key: str = "seq", cache: DataFrame | None = None,
                  cache_key: str = "seq") -> DataFrame:
    """JN6: distinct non-empty sequences the cache does not hold yet."""
    d = seqs.select(F.col(key).alias("seq")).filter(
        F.col("seq").isNotNull() & (F.length("seq") > 0)).distinct()
    if cache is not None:
        d = d.join(cache.select(F.col(cache_key).alias("seq")), "seq", "left_anti")
    return d


def embed_sequences(seqs: DataFrame, key: str = "seq", cache: DataFrame | None = None,
                    embedder=ColumnEmbedder()) -> DataFrame:
    """Vectors for the new distinct sequences only (S5: incremental)."""
    return embedder.apply(new_sequences(seqs, key, cache), "seq")


def embedding_lookup(seqs: DataFrame, key: str = "seq", cache: DataFrame | None = None,
                     embedder=ColumnEmbedder()) -> DataFrame:
    """JN7: cached vectors plus freshly computed ones for the misses."""
    fresh = embed_sequences(seqs, key, cache, embedder)
    if cache is None:
        return fresh
    return cache.select("seq", "embedding").unionByName(fresh)


def append_embeddings(new: DataFrame, path: str) -> None:
    """One append per run (parquet), after the anti-join."""
    new.write.mode("append").parquet(path)


def mean_pool(tokens: DataFrame, key: str = "seq_key", position: str = "position",
              vec: str = "embedding") -> DataFrame:
    """A5: mean of residue vectors per sequence, first and last token dropped.

    One grouped aggregation, partially aggregated map-side: vector sum,
    count, and the first/last token vectors (``min_by``/``max_by`` on
    position); the mean is (sum - first - last) / (n - 2).  No window and no
    join, so a sequence with a third of all tokens is still combined
    per partition before the shuffle.  Sequences of ≤ 2 tokens give null.
    """
    agg = tokens.groupBy(key).agg(
        Summarizer.sum(array_to_vector(F.col(vec))).alias("_sum"),
        F.count(F.lit(1)).alias("_n"),
        F.min_by(vec, position).alias("_first"),
        F.max_by(vec, position).alias("_last"))
    inner = F.zip_with(
        F.zip_with(vector_to_array(F.col("_sum")), F.col("_first"), lambda s, a: s - a),
        F.col("_last"), lambda s, b: s - b)
    pooled = F.transform(inner, lambda s: s / (F.col("_n") - 2))
    return agg.select(key, F.when(F.col("_n") > 2, pooled).alias("embedding"))
