"""J12 evaluation: accuracy, log-loss, exact ROC AUC with ties, hard AUC
(A6, A7, A8).

The AUC is computed without a global sort: scores are grouped (one row per
distinct score), split into equi-depth ranges (bounded list of quantile
cut points), ranked inside each range by a window partitioned on the range,
and offset by the negatives of the lower ranges (a bounded per-range
total).  Ties count one half.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 0.5
CLIP = 1e-15
AUC_RANGES = 256


def _clip(p):
    return F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))


SCORES_PER_RANGE = 1_000_000  # distinct scores ranked inside one window task
MAX_RANGES = 65_536


def _probs(ranges: int) -> list[float]:
    return [i / ranges for i in range(1, ranges)]


def _ranges_for(n_groups: int) -> int:
    return min(MAX_RANGES, max(AUC_RANGES, n_groups // SCORES_PER_RANGE + 1))


def _cut_points(g: DataFrame, score: str, ranges: int) -> list[float]:
    probs = _probs(ranges)
    return (g.agg(F.percentile_approx(score, probs, 10000)).head()[0] or []) if probs else []


def _auc_from_cuts(g: DataFrame, score: str, cuts: list[float]) -> float | None:
    """AUC from ``(score, _pos, _neg)`` groups (one row per distinct score).

    One job: inside each score range a window (partitioned by the range)
    counts the negatives below each score; per range we keep positives,
    negatives and the local credit.  The driver then adds, per range, the
    negatives of all lower ranges — a bounded list (≤ 65 536 ranges).
    """
    splits = [float("-inf")] + sorted(set(c for c in cuts if c is not None)) + [float("inf")]
    if len(splits) < 3:
        g = g.withColumn("_r", F.lit(0.0))
    else:
        g = Bucketizer(splits=splits, inputCol=score, outputCol="_r",
                       handleInvalid="keep").transform(g)
    w = Window.partitionBy("_r").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    local = g.select("_r", "_pos", "_neg",
                     F.coalesce(F.sum("_neg").over(w), F.lit(0)).alias("_below"))
    per_range = sorted(
        (r["_r"], r["p"], r["n"], r["c"]) for r in local.groupBy("_r").agg(
            F.sum("_pos").alias("p"), F.sum("_neg").alias("n"),
            F.sum(F.col("_pos") * (F.col("_below") + 0.5 * F.col("_neg"))).alias("c")).collect())
    n_pos = sum(p for _, p, _, _ in per_range)
    n_neg = sum(n for _, _, n, _ in per_range)
    if not n_pos or not n_neg:
        return None
    credit, neg_before = 0.0, 0
    for _, p, n, c in per_range:
        credit += c + p * neg_before
        neg_before += n
    return credit / (n_pos * n_neg)


def _score_groups(df: DataFrame, label: str, score: str) -> DataFrame:
    return (df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
            .groupBy(score).agg(F.sum(F.col(label)).alias("_pos"),
                                F.sum(1 - F.col(label)).alias("_neg")))


def exact_auc(df: DataFrame, label: str = "label", score: str = "score",
              ranges: int | None = None) -> float | None:
    g = _score_groups(df, label, score)
    if ranges is None:
        ranges = _ranges_for(g.count())
    return _auc_from_cuts(g, score, _cut_points(g, score, ranges))


METRICS_SCHEMA = ("n long, n_pos long, accuracy double, log_loss double, auc double, "
                  "hard_auc double")


def binary_metrics(df: DataFrame, label: str = "label", score: str = "score",
                   threshold: float = THRESHOLD, ranges: int | None = None) -> DataFrame:
    """One row: n, n_pos, accuracy, log_loss, auc, hard_auc.

    ``score`` is a probability; the log-loss clips it to [1e-15, 1-1e-15].
    ``hard_auc`` is the AUC of the thresholded prediction, (TPR + TNR) / 2.
    The input is read once: everything derives from the per-score
    (positives, negatives) groups, which are persisted for the few small
    jobs that follow.  Rows with a null label or score are left out.
    """
    g = _score_groups(df, label, score).persist()
    try:
        s = F.col(score)
        p = _clip(s)
        above = s > threshold
        fixed = ranges or AUC_RANGES
        row = g.agg(
            F.count(F.lit(1)).alias("groups"),
            F.percentile_approx(s, _probs(fixed), 10000).alias("cuts"),
            F.sum(F.col("_pos") + F.col("_neg")).alias("n"),
            F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"),
            F.sum(F.when(above, F.col("_pos")).otherwise(F.col("_neg"))).alias("correct"),
            F.sum(-(F.col("_pos") * F.log(p) + F.col("_neg") * F.log(1 - p))).alias("ll"),
            F.sum(F.when(above, F.col("_pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(~above, F.col("_neg")).otherwise(0)).alias("tn")).head()
        cuts = row["cuts"] or []
        if ranges is None and _ranges_for(row["groups"]) != fixed:
            cuts = _cut_points(g, score, _ranges_for(row["groups"]))
        auc = _auc_from_cuts(g, score, cuts)
    finally:
        g.unpersist()
    n, n_pos, n_neg = row["n"] or 0, row["n_pos"] or 0, row["n_neg"] or 0
    out = (int(n), int(n_pos),
           row["correct"] / n if n else None,
           row["ll"] / n if n else None,
           auc,
           (row["tp"] / n_pos + row["tn"] / n_neg) / 2 if n_pos and n_neg else None)
    return df.sparkSession.createDataFrame([out], METRICS_SCHEMA)
