"""J14 reward reports and J16 group-relative advantage.

Everything is a grouped aggregation (partial aggregation before the
shuffle) or a filter/projection; per-group statistics are joined back on
the group key instead of a window, so a prompt holding a third of the rows
is combined map-side and the join's skewed partition is split by AQE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T

TRACE_EVERY = 50       # log a trace every 50th step
THINK_HEAD = 100       # characters of think text in a trace
SKETCH_K = 400         # size of a quantile sketch
ADVANTAGE_EPS = 1e-4   # added to the group standard deviation


def reward_report(scored: DataFrame, by: Sequence[str] = ("step",),
                  value: str = "total_reward",
                  components: Sequence[str] = ("format_reward", "mention_reward",
                                               "answer_reward"),
                  spread: bool = False) -> DataFrame:
    """Count, mean, bounds, deviation and approximate median of the total
    (exact up to 10 000 values a group) and the means of the components;
    ``spread`` adds bounds and approximate median of each component."""
    aggs = [F.count(F.lit(1)).alias("n"),
            F.avg(value).alias("mean_total"), F.min(value).alias("min_total"),
            F.max(value).alias("max_total"), F.stddev_samp(value).alias("std_total"),
            F.percentile_approx(value, 0.5, 10000).alias("median_total")]
    aggs += [F.avg(c).alias(f"mean_{c}") for c in components]
    for c in components if spread else ():
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"),
                 F.percentile_approx(c, 0.5, 10000).alias(f"approx_median_{c}")]
    return scored.groupBy(*by).agg(*aggs)


def reward_sketches(scored: DataFrame, by: Sequence[str] = ("step",),
                    values: Sequence[str] = ("total_reward",), k: int = SKETCH_K) -> DataFrame:
    """A15 to be merged: per group the row count, each value's sum, bounds and a
    KLL sketch of it (some kilobytes, whatever the group's size)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for v in values:
        x = F.col(v).cast("double")
        aggs += [F.sum(x).alias(f"sum_{v}"), F.min(x).alias(f"min_{v}"), F.max(x).alias(f"max_{v}"),
                 F.kll_sketch_agg_double(x, k).alias(f"sketch_{v}")]
    return scored.groupBy(*by).agg(*aggs)


def merged_report(sketches: DataFrame, by: Sequence[str] = (), values: Sequence[str] = ("total_reward",),
                  quantiles: Sequence[float] = (0.1, 0.5, 0.9), k: int = SKETCH_K) -> DataFrame:
    """The report of any coarser groups from stored sketches, without their rows:
    n, mean, bounds and quantiles.  A quantile's rank is off by about 1.7 / k of n
    at most in 99 of 100 cases; groups of up to ``k`` rows have exact ones.  A
    group whose values are all null has null quantiles."""
    aggs = [F.sum("n").alias("n")]
    for v in values:
        aggs += [F.sum(f"sum_{v}").alias(f"_sum_{v}"), F.min(f"min_{v}").alias(f"min_{v}"),
                 F.max(f"max_{v}").alias(f"max_{v}"), F.kll_merge_agg_double(f"sketch_{v}", k).alias(f"_sketch_{v}")]
    out = sketches.groupBy(*by).agg(*aggs)
    cols = [*by, "n"]
    for v in values:
        size = F.kll_sketch_get_n_double(f"_sketch_{v}")
        cols += [(F.col(f"_sum_{v}") / size).alias(f"mean_{v}"), f"min_{v}", f"max_{v}"]
        cols += [F.when(size > 0, F.kll_sketch_get_quantile_double(f"_sketch_{v}", F.lit(float(q))))
                 .alias(f"q{round(100 * q)}_{v}") for q in quantiles]
    return out.select(*cols)


def reward_trace(scored: DataFrame, text_col: str = "completion", step: str = "step",
                 every: int = TRACE_EVERY, cols: Sequence[str] = ()) -> DataFrame:
    """Every ``every``-th step (the reference's sampling rule), with the
    extracted answer and the head of the think text."""
    t = F.col(text_col)
    return scored.filter(F.col(step) % every == 0).select(
        *cols, T.binary_answer(t).alias("answer"),
        F.substring(T.think_text(t), 1, THINK_HEAD).alias("think_head"))


def group_advantage(scored: DataFrame, group: Sequence[str], value: str = "total_reward",
                    eps: float = ADVANTAGE_EPS) -> DataFrame:
    """(r - mean) / (std + eps) inside each group (sample std; a group
    of one has no spread and gets 0)."""
    group = list(group)
    stats = scored.groupBy(*group).agg(F.avg(value).alias("_mean"),
                                       F.stddev_samp(value).alias("_std"),
                                       F.count(F.lit(1)).alias("group_size"))
    adv = (F.col(value) - F.col("_mean")) / (F.col("_std") + eps)
    return (scored.join(stats, group)
            .withColumn("advantage", F.coalesce(adv, F.lit(0.0)))
            .drop("_mean", "_std"))


def best_of_group(scored: DataFrame, group: Sequence[str], value: str = "total_reward",
                  pos: str = "pos") -> DataFrame:
    """Highest value per group, ties to the lowest position (max_by)."""
    order = F.struct(F.col(value), (-F.col(pos)).alias("_neg_pos"))
    return scored.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by(F.col(pos), order).alias("best_pos"),
        F.max(value).alias("best_value"))
