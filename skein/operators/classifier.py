"""J12 training: a pair classifier with Spark ML (R).

Spark ML's multilayer perceptron (sigmoid hidden units, softmax output,
L-BFGS) fills the role of the reference's small ReLU network trained with
Adam; weights differ, the capability is the same.  Gradients are
tree-aggregated across executors.  The train/validation split is by a hash
of the row key (80/20), so it is stable under re-partitioning and retries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.metrics import binary_metrics
from skein.session import cut_lineage

TRAIN_PERCENT = 80
HIDDEN = 32
MAX_ITER = 15  # the reference trains for 15 epochs


def split_column(key) -> F.Column:
    """'train' when md5(key) falls in the first 80 of 100 buckets."""
    k = F.col(key) if isinstance(key, str) else key
    b = F.pmod(F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("long"), 100)
    return F.when(b < TRAIN_PERCENT, F.lit("train")).otherwise(F.lit("validation"))


def training_table(with_vectors: DataFrame, key: str, label: str = "label",
                   features: str = "features") -> DataFrame:
    """JN3: rows lacking a vector are dropped (inner semantics)."""
    return (with_vectors.filter(F.col(features).isNotNull())
            .select(key, array_to_vector(F.col(features)).alias("features"),
                    F.col(label).cast("double").alias("label"),
                    split_column(key).alias("split")))


def split_report(with_vectors: DataFrame, key: str, label: str = "label",
                 features: str = "features") -> DataFrame:
    """Per split: rows to train on, positive ones, and rows dropped by JN3."""
    has = F.col(features).isNotNull()
    return with_vectors.groupBy(split_column(key).alias("split")).agg(
        F.count_if(has).alias("n"), F.count_if(has & (F.col(label) == 1)).alias("n_positive"),
        F.count_if(~has).alias("n_dropped"))


def fit_pair_classifier(train: DataFrame, input_dim: int, hidden: Sequence[int] = (HIDDEN,),
                        max_iter: int = MAX_ITER, seed: int = 42):
    mlp = MultilayerPerceptronClassifier(layers=[input_dim, *hidden, 2], maxIter=max_iter,
                                         seed=seed, featuresCol="features", labelCol="label")
    return mlp.fit(train)


def evaluate(model, df: DataFrame) -> DataFrame:
    pred = model.transform(df).select(
        "split", "label", F.get(vector_to_array("probability"), 1).alias("score"))
    parts = []
    for s in ("train", "validation"):
        m = binary_metrics(pred.filter(F.col("split") == s), "label", "score")
        parts.append(m.select(F.lit(s).alias("split"), "*"))
    return parts[0].unionByName(parts[1])


def train_and_evaluate(with_vectors: DataFrame, key: str, input_dim: int,
                       label: str = "label", max_iter: int = MAX_ITER, seed: int = 42):
    """Fit on the train split, report metrics on both splits.

    The training table is checkpointed to the shared folder first: the
    optimiser re-reads it every iteration and a lost executor then recovers
    from the written table, not from the joins that produced it.
    """
    table = cut_lineage(training_table(with_vectors, key, label))
    model = fit_pair_classifier(table.filter(F.col("split") == "train"), input_dim,
                                max_iter=max_iter, seed=seed)
    return model, evaluate(model, table)


def save_model(model, path: str) -> None:
    """Spark ML persistence (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml.classification import MultilayerPerceptronClassificationModel
    return MultilayerPerceptronClassificationModel.load(path)
