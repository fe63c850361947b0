"""Attach embedding vectors to pairs (JN1, JN2, JN3, JN8, N6, A13).

Two keyed left joins of the pair table on the embedding table.  Only keys
travel with the pairs until the join; the vector table is broadcast only
when its size is proven small, else both sides shuffle on the key (AQE
splits a hot reference sequence).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import vectors as V
from skein.operators.guards import (broadcast_vectors_if_bounded, require_unique,
                                   vectors_fit_broadcast)

MODES = ("diff", "concat", "diff_plus_target")


def _lookup(vectors: DataFrame, key: str, vec: str, alias_key: str, alias_vec: str,
            broadcast: bool) -> DataFrame:
    side = vectors.select(F.col(key).alias(alias_key), F.col(vec).alias(alias_vec))
    return F.broadcast(side) if broadcast else side


def attach_pair_vectors(pairs: DataFrame, vectors: DataFrame, key_a="seqA", key_b="seqB",
                        mode: str = "diff", lower_probe: bool = False,
                        targets: DataFrame | None = None, target_key: str = "target_id",
                        vec_key: str = "seq", vec_col: str = "embedding",
                        broadcast: bool | None = None, keep_vectors: bool = False,
                        check_unique: bool = False) -> DataFrame:
    """Add ``features`` (a-b, [a;b] or a-b+t) and ``has_vectors``.

    ``key_a``/``key_b`` may be column names or Columns.  A missing vector on
    either side gives null features and ``has_vectors`` false (JN1); with
    ``lower_probe`` the probe keys are lower-cased, the table's are not (JN2).
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    ka = F.col(key_a) if isinstance(key_a, str) else key_a
    kb = F.col(key_b) if isinstance(key_b, str) else key_b
    if lower_probe:
        ka, kb = F.lower(ka), F.lower(kb)
    if check_unique:
        # A duplicate key would fan pair rows out; fail naming the keys.
        require_unique(vectors, [vec_key])
    if broadcast is not False:      # a wish to broadcast is checked as well
        broadcast = vectors_fit_broadcast(vectors, vec_col)  # one probe, both lookups
    va = _lookup(vectors, vec_key, vec_col, "_ka", "vecA", broadcast)
    vb = _lookup(vectors, vec_key, vec_col, "_kb", "vecB", broadcast)
    out = (pairs.withColumn("_ka", ka).withColumn("_kb", kb)
           .join(va, "_ka", "left").join(vb, "_kb", "left"))
    if mode == "diff":
        feats = V.vsub("vecA", "vecB")
    elif mode == "concat":
        feats = V.vconcat("vecA", "vecB")
    else:
        if targets is None:
            raise ValueError("diff_plus_target needs a targets table")
        t = targets.select(F.col(target_key).alias("_tk"), F.col(vec_col).alias("_tvec"))
        t = broadcast_vectors_if_bounded(t, "_tvec")
        out = out.join(t, out[target_key] == t["_tk"], "left").drop("_tk")
        feats = V.vadd(V.vsub("vecA", "vecB"), "_tvec")
    present = F.col("vecA").isNotNull() & F.col("vecB").isNotNull()
    if mode == "diff_plus_target":
        present = present & F.col("_tvec").isNotNull()
    out = out.withColumn("features", F.when(present, feats)).withColumn("has_vectors", present)
    drop = ["_ka", "_kb", "_tvec"] + ([] if keep_vectors else ["vecA", "vecB"])
    return out.drop(*[c for c in drop if c in out.columns])


def missing_vector_count(with_vectors: DataFrame) -> DataFrame:
    """Rows lacking a vector on either side (one aggregated row)."""
    return with_vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((~F.col("has_vectors")).cast("int")).alias("invalid"))
