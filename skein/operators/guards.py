"""Size and uniqueness guards used before broadcasts and keyed lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Broadcast budget for a lookup side (bytes, estimated from rows × row width).
BROADCAST_BYTES = 64 * 1024 * 1024


#: Bytes of an array element by its type; other types count as the widest.
ELEMENT_BYTES = {"float": 4, "int": 4, "short": 2, "byte": 1}


def vectors_fit_broadcast(df: DataFrame, vec_col: str, key_bytes: int = 48,
                          budget: int = BROADCAST_BYTES) -> bool:
    """One bounded probe job: count the rows (stopping past the most that
    could fit) and the widest vector; true when rows × row width is within
    the budget."""
    element = ELEMENT_BYTES.get(df.schema[vec_col].dataType.elementType.typeName(), 8)
    min_row = key_bytes + 16
    cap = budget // min_row
    probe = (df.select(F.size(vec_col).alias("d")).limit(cap + 1)
             .agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).head())
    n, dim = probe["n"], max(probe["d"] or 0, 0)
    return n <= cap and n * (min_row + element * dim) <= budget


def broadcast_vectors_if_bounded(df: DataFrame, vec_col: str, key_bytes: int = 48,
                                 budget: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only behind :func:`vectors_fit_broadcast`."""
    return F.broadcast(df) if vectors_fit_broadcast(df, vec_col, key_bytes, budget) else df


class DuplicateKeyError(ValueError):
    pass


def require_unique(df: DataFrame, keys: list[str], sample: int = 10) -> None:
    """Fail with example keys when ``keys`` are not unique in ``df``.

    One grouped count (partially aggregated map-side); only a bounded sample
    of offending keys reaches the driver.
    """
    dup = df.groupBy(*keys).count().filter(F.col("count") > 1)
    found = dup.limit(sample).collect()
    if found:
        raise DuplicateKeyError(f"duplicate keys on {keys}: {[tuple(r) for r in found]}")
