"""The pair network itself, trained with Adam.

Two layers with ReLU and a sigmoid, cross-entropy on the logit.  Training rows are
written in ``batches`` parts by a hash of their key; a step reads one part, every task
adds up the gradient of its rows, the sums are added up over the tasks, and the driver,
which holds the weights (their number is the model's), takes the Adam step.  The order
of the parts in each epoch and the first weights come from a seed, so a run is the
same on any number of tasks but for the order of its sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.classifier import split_column
from skein.operators.metrics import binary_metrics
from skein.operators.scoring import HIDDEN, PairScorer, score_pairs
from skein.session import scratch_path

EPOCHS = 15
BATCHES = 4
RATE, DECAY1, DECAY2, EPS = 1e-3, 0.9, 0.999, 1e-8


def first_weights(dim: int, hidden: int = HIDDEN, seed: int = 42) -> np.ndarray:
    """All weights in one array: W1 (hidden x dim), b1, W2, b2; uniform within one
    over the root of a layer's inputs."""
    rng = np.random.default_rng(seed)
    a, b = 1 / np.sqrt(dim), 1 / np.sqrt(hidden)
    return np.concatenate([rng.uniform(-a, a, hidden * dim), rng.uniform(-a, a, hidden),
                           rng.uniform(-b, b, hidden), rng.uniform(-b, b, 1)])


def _layers(w: np.ndarray, dim: int):
    hidden = (len(w) - 1) // (dim + 2)
    cut = hidden * dim
    return w[:cut].reshape(hidden, dim), w[cut:cut + hidden], w[cut + hidden:cut + 2 * hidden], w[-1]


def gradient(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum over rows of the loss's gradient, then the loss and the rows."""
    w1, b1, w2, b2 = _layers(w, x.shape[1])
    h = x @ w1.T + b1
    relu = np.maximum(h, 0)
    z = relu @ w2 + b2
    d = 1 / (1 + np.exp(-z)) - y
    back = (d[:, None] * w2) * (h > 0)
    loss = np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))
    return np.concatenate([(back.T @ x).ravel(), back.sum(0), relu.T @ d, [d.sum()], [loss.sum(), len(y)]])


class Adam:
    """Steps over the mean gradient."""

    def __init__(self, size: int, rate: float = RATE):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = DECAY1 * self.m + (1 - DECAY1) * g
        self.v = DECAY2 * self.v + (1 - DECAY2) * g * g
        m, v = self.m / (1 - DECAY1 ** self.t), self.v / (1 - DECAY2 ** self.t)
        return w - self.rate * m / (np.sqrt(v) + EPS)


def batch_order(epochs: int, batches: int, seed: int) -> Iterator[int]:
    rng = np.random.default_rng(seed + 1)
    for _ in range(epochs):
        yield from rng.permutation(batches).tolist()


def batch_number(key, batches: int):
    return F.pmod(F.xxhash64(F.lit("batch"), F.col(key).cast("string")), F.lit(batches)).cast("int")


def _sums(rows: DataFrame, w: np.ndarray, dim: int) -> np.ndarray | None:
    """The gradient over all rows; None without rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(w) + 2)
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            total += gradient(w, x, b.column(1).to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["g"])

    total = rows.select("features", "label").mapInArrow(run, "g array<double>") \
        .groupBy(F.lit(1)).agg(Summarizer.sum(array_to_vector("g")).alias("g")).first()
    return total["g"].toArray() if total and total["g"][-1] else None


def fit(table: DataFrame, key: str, dim: int, label: str = "label", features: str = "features",
        hidden: int = HIDDEN, epochs: int = EPOCHS, batches: int = BATCHES, seed: int = 42) -> tuple[PairScorer, list[float]]:
    """(scorer, mean loss of each epoch).  Rows without features or a label are left
    out; a part without rows takes no step."""
    spark = table.sparkSession
    path = scratch_path(spark, "training-rows")
    table.filter(F.col(features).isNotNull() & F.col(label).isNotNull()).select(
        F.col(features).cast("array<double>").alias("features"), F.col(label).cast("double").alias("label"),
        batch_number(key, batches).alias("batch")).write.partitionBy("batch").parquet(path)
    rows = spark.read.schema("features array<double>, label double, batch int").parquet(path)
    w, losses = first_weights(dim, hidden, seed), []
    adam, seen = Adam(len(w)), []
    for i, part in enumerate(batch_order(epochs, batches, seed), 1):
        g = _sums(rows.filter(F.col("batch") == part), w, dim)
        if g is not None:
            w = adam.step(w, g[:-2] / g[-1])
            seen.append(g[-2:])
        if i % batches == 0 and seen:
            losses.append(float(sum(s[0] for s in seen) / sum(s[1] for s in seen)))
            seen = []
    w1, b1, w2, b2 = _layers(w, dim)
    return PairScorer(w1.tolist(), b1.tolist(), w2.tolist(), float(b2)), losses


def train_and_evaluate(with_vectors: DataFrame, key: str, dim: int, label: str = "label",
                       **options) -> tuple[PairScorer, DataFrame]:
    """Fit on the train split (``classifier.split_column``), metrics of both splits."""
    rows = with_vectors.filter(F.col("features").isNotNull()).select(
        key, "features", F.lit(True).alias("has_vectors"), F.col(label).alias("label"), split_column(key).alias("split"))
    scorer, _ = fit(rows.filter(F.col("split") == "train"), key, dim, **options)
    scored = score_pairs(rows, scorer).select("split", "label", "probability")
    parts = [binary_metrics(scored.filter(F.col("split") == s), "label", "probability").select(F.lit(s).alias("split"), "*")
             for s in ("train", "validation")]
    return scorer, parts[0].unionByName(parts[1])
