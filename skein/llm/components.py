"""Distributed union-find over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def _flat(parent: DataFrame) -> DataFrame:
    """Pointer jumping until every vertex points at a root."""
    while True:
        up = parent.select(F.col("id").alias("via"), F.col("root").alias("above"))
        parent = written(
            parent.join(up, F.col("root") == F.col("via"))
            .select("id", F.col("above").alias("root"),
                    (F.col("root") != F.col("above")).alias("moved")), "jump")
        moved = parent.filter("moved").limit(1).count()
        parent = parent.select("id", "root")
        if not moved:
            return parent


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every end of a link; root is the smallest id reachable.

    ``links`` has columns a and b.  Each round hooks every root to the smallest
    root it is linked to, flattens the pointers and contracts the links; links
    shrink from round to round.  All steps are grouped minima (summed before
    the shuffle) and joins, so a vertex with very many links is no single
    task.  No links give an empty table; self-links and null ends are ignored.
    """
    cur = written(links.filter("a <> b").select("a", "b").distinct(), "links")
    whole = None
    while cur.limit(1).count():
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")) \
            .select("id", F.least("id", "m").alias("root"))
        parent = _flat(written(hook, "hook"))
        if whole is None:
            whole = parent
        else:
            up = parent.select(F.col("id").alias("via"), F.col("root").alias("above"))
            whole = written(whole.join(up, F.col("root") == F.col("via"), "left")
                            .select("id", F.coalesce("above", "root").alias("root")), "roots")
        pa, pb = (parent.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        cur = written(cur.join(pa, "a").join(pb, "b").filter("ra <> rb")
                      .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    if whole is None:
        kind = links.schema["a"].dataType
        return links.limit(0).select(F.col("a").cast(kind).alias("id"), F.col("a").alias("root"))
    return whole
