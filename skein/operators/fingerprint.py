"""Content fingerprint of an embedding table, and what differs.

Each row hashes ``key:q1,q2,…`` with values quantised to 1e-6; the table
fingerprint is the sum of the 60-bit row hashes modulo 2**60.  The sum is
order-free, so it is one partially-aggregated global aggregate: no sort, no
collect, nothing proportional to the table reaches one task.

``hash_tree`` is the fingerprint that can tell what differs: entries sorted by key
inside leaves named by the first hexadecimal digits of md5(key), hashes of the
leaves' lists, of lists of leaves, and of those.  ``table_diff`` compares two
trees from the root and opens only the leaves that are unequal.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODULUS = 1 << 60
SCALE = 1_000_000


def row_hash(key: Column, vec: Column) -> Column:
    q = F.transform(vec, lambda x: F.floor(x.cast("double") * SCALE + 0.5).cast("string"))
    text = F.concat(key.cast("string"), F.lit(":"), F.array_join(q, ","))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")


def table_fingerprint(df: DataFrame, key: str = "seq", vec: str = "embedding") -> DataFrame:
    """One row: ``n`` and ``fingerprint`` (bigint in [0, 2**60))."""
    h = row_hash(F.col(key), F.col(vec))
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.pmod(F.sum(h), F.lit(MODULUS)).cast("long").alias("fingerprint"))


def verify_fingerprint(df: DataFrame, expected: int | None, key: str = "seq",
                       vec: str = "embedding") -> bool | None:
    """Warn on mismatch; None when there is no reference value to check."""
    if expected is None:
        return None
    got = table_fingerprint(df, key, vec).head()["fingerprint"]
    if got != expected:
        warnings.warn(f"embedding fingerprint mismatch: expected {expected}, got {got}")
        return False
    return True


LEAF_ROWS = 1024       # keys of a leaf, about
MOST_DIGITS = 8


def tree_digits(n_keys: int) -> int:
    """Hexadecimal digits that name a leaf of about ``LEAF_ROWS`` keys."""
    digits = 2
    while digits < MOST_DIGITS and n_keys > LEAF_ROWS << (4 * digits):
        digits += 1
    return digits


def _entries(df: DataFrame, key: str, vec: str, digits: int) -> DataFrame:
    """One entry per key: its leaf, its rows and the sum of their hashes, so a key
    that is repeated, however often, is still one entry.  A null key is the key
    ``\\N``; a null vector, or a null in one, hashes as such."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("\\N"))
    q = F.transform(vec, lambda x: F.coalesce(
        F.when(F.abs(x) < 1e9, F.floor(x.cast("double") * SCALE + 0.5).cast("string")).otherwise(x.cast("string")),
        F.lit("null")))
    text = F.concat(name, F.lit(":"), F.coalesce(F.array_join(q, ","), F.lit("null")))
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.select(name.alias("key"), h.alias("h")).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("h").alias("h")) \
        .select(F.substring(F.md5("key"), 1, digits).alias("leaf"), "key",
                F.concat_ws(":", "key", F.col("n").cast("string"), F.col("h").cast("string")).alias("entry"), "n")


def _list_hash(entries) -> Column:
    return F.md5(F.array_join(F.array_sort(F.collect_list(entries)), "\n"))


def hash_tree(df: DataFrame, key: str = "seq", vec: str = "embedding", digits: int = 4) -> DataFrame:
    """(level, node, n, hash): the root (level 0, node ''), inner nodes (1) and
    leaves (2), named by prefixes of ``digits // 2`` and ``digits`` hexadecimal
    digits.  Choose ``digits`` by :func:`tree_digits` and keep it: trees of other
    depths don't compare.  Every list that is sorted has a bounded length."""
    leaves = _entries(df, key, vec, digits).groupBy("leaf").agg(
        F.sum("n").alias("n"), _list_hash("entry").alias("hash"))
    inner = leaves.groupBy(F.substring("leaf", 1, digits // 2).alias("node")).agg(
        F.sum("n").alias("n"), _list_hash(F.concat("leaf", "hash")).alias("hash"))
    root = inner.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), _list_hash(F.concat("node", "hash")).alias("hash"))
    levels = [(0, root.withColumn("node", F.lit(""))), (1, inner), (2, leaves.withColumnRenamed("leaf", "node"))]
    parts = [t.select(F.lit(level).alias("level"), "node", "n", "hash") for level, t in levels]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def unequal_nodes(old: DataFrame, new: DataFrame, level: int) -> DataFrame:
    """Names of the nodes of a level whose hashes differ or which one tree lacks."""
    a, b = (t.filter(F.col("level") == level).select("node", F.col("hash").alias(h)) for t, h in ((old, "a"), (new, "b")))
    return a.join(b, "node", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("node")


def table_diff(old: DataFrame, new: DataFrame, old_tree: DataFrame, new_tree: DataFrame,
               key: str = "seq", vec: str = "embedding", digits: int = 4) -> DataFrame:
    """(key, change): keys that ``new`` added, removed or changed.

    Equal roots read no entry.  Otherwise the unequal inner nodes name the leaves to
    compare, and only entries of unequal leaves are joined by key.
    """
    roots = [t.filter("level = 0").select("hash").head() for t in (old_tree, new_tree)]
    if roots[0] == roots[1]:
        return old.sparkSession.createDataFrame([], "key string, change string")
    half = digits // 2
    inner = unequal_nodes(old_tree, new_tree, 1)
    leaves = [t.filter("level = 2").join(inner.select(F.col("node").alias("_up")),
                                         F.substring("node", 1, half) == F.col("_up"), "left_semi")
              for t in (old_tree, new_tree)]
    opened = unequal_nodes(*leaves, 2).select(F.col("node").alias("leaf"))
    a, b = (_entries(df, key, vec, digits).join(opened, "leaf", "left_semi").select("key", F.col("entry").alias(name))
            for df, name in ((old, "a"), (new, "b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return a.join(b, "key", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("key", change.alias("change"))
