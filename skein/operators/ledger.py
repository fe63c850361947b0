"""The ledger of designed sequences.

``last_scores``: per sequence the last design reward (by step, pos) and the
number of times it was produced — one grouped aggregation with map-side
partial aggregation (a hot sequence is combined before the shuffle).

``prior_counts``: for each completion, how often its sequence was produced
before it.  A sequence holding a third of the rows never lands in one window
task: per-(sequence, step) counts are summed inside ranges of 1 024 steps, the
ranges' totals inside ranges of ranges, and so on (``LEVELS`` levels cover 2**40
steps), plus the rank inside the (sequence, step) group, which is bounded by
the batch size.  Invalid designs share one null key, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEP_RANGE = 1024
LEVELS = 4


def last_scores(scored: DataFrame, key: str = "generate_seq", value: str = "design_reward",
                order=("step", "pos")) -> DataFrame:
    return scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by(value, F.struct(*order)).alias("generate_seq_prob"))


def prior_counts(df: DataFrame, key: str = "generate_seq", step: str = "step",
                 pos: str = "pos", out: str = "prior_count") -> DataFrame:
    per_step = df.groupBy(F.col(key).alias("_k"), F.col(step).alias("_l0")).agg(
        F.count(F.lit(1)).alias("_c"))
    before, names = per_step, []
    for level in range(1, LEVELS + 1):
        # prefix inside ranges of STEP_RANGE entries; the ranges' totals go up
        low, up = f"_l{level - 1}", f"_l{level}"
        ranged = per_step.withColumn(up, F.floor(F.col(low) / STEP_RANGE))
        inside = Window.partitionBy("_k", up).orderBy(low).rowsBetween(Window.unboundedPreceding, -1)
        part = ranged.select("_k", low, up, F.coalesce(F.sum("_c").over(inside), F.lit(0)).alias(f"_b{level}"))
        if level == 1:
            before = part
        else:
            p = part.withColumnsRenamed({"_k": "_pk", low: "_pl"})
            before = before.join(p, before["_k"].eqNullSafe(p["_pk"]) & (before[low] == p["_pl"])).drop("_pk", "_pl")
        names.append(f"_b{level}")
        per_step = ranged.groupBy("_k", up).agg(F.sum("_c").alias("_c"))
    prefix = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    before = before.select("_k", F.col("_l0").alias("_s"), prefix.alias("_before"))
    rank = F.row_number().over(Window.partitionBy(key, step).orderBy(pos)) - 1
    ranked = df.withColumn("_inside", rank)
    cond = ranked[key].eqNullSafe(before["_k"]) & (ranked[step] == before["_s"])
    return (ranked.join(before, cond)
            .withColumn(out, (F.col("_before") + F.col("_inside")).cast("long"))
            .drop("_k", "_s", "_before", "_inside"))


def write_snapshot(ledger: DataFrame, path: str) -> None:
    """Overwrite the ledger snapshot."""
    ledger.write.mode("overwrite").parquet(path)


def append_scored(rows: DataFrame, path: str) -> None:
    """Append a batch of scored designs."""
    rows.write.mode("append").parquet(path)
