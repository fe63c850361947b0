"""Preference pairs from design cycles (S2, A1, JN5, JN9, P2).

Cycles are unioned and deduplicated on the source columns; each sequence
draws ``k`` partners uniformly with replacement.  Draws are hash-based —
``md5(seed:seq:k) mod n`` against a dense index — so the result does not
depend on partitioning and re-running a lost task gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.guards import DuplicateKeyError, require_unique

PARTNERS = 5          # partners drawn per sequence
INDEX_BUCKETS = 4096  # md5-prefix buckets of the dense index (3 hex digits)


def pair_label(a="seqA_plddt", b="seqB_plddt") -> Column:
    """1 if a > b else 0 (ties → 0); null when either score is null."""
    ca = F.col(a) if isinstance(a, str) else a
    cb = F.col(b) if isinstance(b, str) else b
    return F.when(ca.isNull() | cb.isNull(), F.lit(None).cast("int")).when(
        ca > cb, 1).otherwise(0)


def dedupe_cycles(cycles: DataFrame, cols=("generate_seq", "plddt")) -> DataFrame:
    """A1: full-row dedupe on the source columns (not ``cycle``)."""
    return cycles.select(*cols).dropDuplicates(list(cols))


def resolve_scores(rows: DataFrame, key: str = "generate_seq", score: str = "plddt",
                   resolve: str = "error") -> DataFrame:
    """JN5: one score per sequence.  ``error`` fails on a sequence with two
    scores (naming them), ``max`` keeps the highest."""
    if resolve == "error":
        require_unique(rows, [key])
        return rows.select(key, score)
    if resolve == "max":
        return rows.groupBy(key).agg(F.max(score).alias(score))
    raise ValueError("resolve must be 'error' or 'max'")


def _hex_to_long(hex_col: Column, digits: int = 15) -> Column:
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("long")


def dense_index(df: DataFrame, key: str, idx: str = "idx") -> tuple[DataFrame, int]:
    """Give each row a dense index 0..n-1 in ``(md5(key), key)`` order.

    Rows fall into md5-prefix buckets (uniform for distinct keys); one
    bounded job returns the per-bucket counts (≤ 4096 numbers), whose prefix
    sums become offsets; inside each bucket a window numbers the rows.  No
    global sort and no single-partition window.
    """
    h = F.md5(F.col(key).cast("string"))
    keyed = df.withColumn("_h", h).withColumn(
        "_b", F.conv(F.substring(F.col("_h"), 1, 3), 16, 10).cast("int"))
    counts = {r["_b"]: r["count"] for r in keyed.groupBy("_b").count().collect()}
    offsets, run = [], 0
    for b in range(INDEX_BUCKETS):
        offsets.append(run)
        run += counts.get(b, 0)
    w = Window.partitionBy("_b").orderBy("_h", key)
    out = keyed.withColumn(
        idx, F.element_at(F.lit(offsets), F.col("_b") + 1) + F.row_number().over(w) - 1)
    return out.drop("_h", "_b"), run


def sample_partners(rows: DataFrame, key: str = "generate_seq", score: str = "plddt",
                    partners: int = PARTNERS, seed: int = 42) -> DataFrame:
    """JN9: ``partners`` draws per sequence, with replacement, self allowed.

    Output ``seqA, seqA_plddt, k, seqB, seqB_plddt, label``: 5n rows for n
    sequences; the partner side is joined on its dense index.
    """
    indexed, n = dense_index(rows.select(key, score), key)
    if n == 0:
        return rows.sparkSession.createDataFrame(
            [], "seqA string, seqA_plddt double, k int, seqB string, seqB_plddt double, "
                "label int")
    # Both sides read the same indexed plan, so Spark reuses its exchange.
    a = indexed.select(F.col(key).alias("seqA"), F.col(score).alias("seqA_plddt"),
                    F.explode(F.sequence(F.lit(0), F.lit(partners - 1))).alias("k"))
    draw = F.concat_ws(":", F.lit(str(seed)), F.col("seqA"), F.col("k").cast("string"))
    a = a.withColumn("_t", F.pmod(_hex_to_long(F.md5(draw)), F.lit(n)))
    b = indexed.select(F.col("idx").alias("_t"), F.col(key).alias("seqB"),
                       F.col(score).alias("seqB_plddt"))
    out = a.join(b, "_t").drop("_t")
    return out.withColumn("label", pair_label())


def cycle_pairs(cycles: DataFrame, resolve: str = "error", partners: int = PARTNERS,
                seed: int = 42) -> DataFrame:
    """J02 end to end: dedupe → one score per sequence → sampled pairs."""
    rows = resolve_scores(dedupe_cycles(cycles), resolve=resolve)
    return sample_partners(rows, partners=partners, seed=seed)


__all__ = ["DuplicateKeyError", "cycle_pairs", "dedupe_cycles", "dense_index", "pair_label",
           "resolve_scores", "sample_partners"]


def write_pairs(pairs: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Persist the pair table (parquet; CSV with a header on request)."""
    writer = pairs.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
