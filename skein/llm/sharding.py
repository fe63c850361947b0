"""Sharding by vector bin packing.

Law ``bytes``: shard sizes come out near equal; tokens and rows are balanced
jointly as far as that allows.  Documents with equal texts form a group and stay
together; a group that holds more bytes than one shard is to get (fewer than
``shards`` can) is split by row into units of an eighth of a shard.

Placing is a greedy vector packing: from heavy to light, each unit goes to the bin
where the dot product of its vector (bytes, tokens, rows, as shares of the totals) with
the bin's residual capacity is highest, among the bins whose capacity in bytes it does
not exceed (if none, the emptiest).  Every unit is placed by that rule, in parts of
about ``UNITS`` units by a hash of the group: a task packs a part into as many bins as
there are shards, and the bins of all parts are packed into the shards by the same
rule.  With one part that is the plain greedy packing.  A task holds the vectors of a
part, the driver those of ``MOST_PARTS`` times ``shards`` bins at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

UNITS = 1 << 16
MOST_PARTS = 1 << 13
PIECES_A_SHARD = 8
SLOT_LANES = 256


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each row of ``vectors`` (n, 3): bytes, tokens, rows."""
    totals = np.maximum(vectors.sum(axis=0), 1.0)
    share = vectors / totals
    left = np.full((shards, vectors.shape[1]), 1.0 / shards)
    out = np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(share)), -share[:, 0])).tolist():
        v = share[i]
        score = np.where(left[:, 0] >= v[0], left @ v, -np.inf)
        best = score.max()
        # ties: the bin with most bytes left, then the lowest number
        pick = int(np.where(score == best, left[:, 0], -np.inf).argmax())
        left[pick] -= v
        out[i] = pick
    return out


def _packed(shards: int):
    """Bins of the units of each part; a task's parts come one after another."""
    names = ["part", "grp", "piece", "bytes", "tokens", "rows"]

    def bins(rows: list[list]) -> pa.RecordBatch:
        at = pack(np.array(rows[3:], float).T.reshape(-1, 3), shards)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows), pa.array(at.astype(np.int32))],
                                          names=[*names, "bin"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in names]
        for batch in batches:
            part = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi > lo and held[0] and held[0][0] != part[lo]:
                    yield bins(held)
                    held = [[] for _ in names]
                for c, column in zip(held, batch.columns):
                    c += column.slice(lo, hi - lo).to_pylist()
        if held[0]:
            yield bins(held)
    return run


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    size: UTF-8 bytes of the text (null: none) plus 1.  Null texts have the
    CRC-32 of the empty text and form one group with empty ones.  slot numbers
    the rows of a shard gaplessly from 0.  grown_shard is null under this law.
    Repeated rows are rows of their own; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.xxhash64(text).alias("grp")).withColumn("row", F.monotonically_increasing_id()), "rows")

    total = rows.agg(F.sum("size").alias("size")).head()["size"] or 0
    capacity = max(total // shards, 1)
    large = rows.groupBy("grp").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > capacity) \
        .select("grp", F.ceil(F.col("bytes") * PIECES_A_SHARD / capacity).cast("long").alias("pieces"))
    large = F.broadcast(written(large, "large"))         # fewer than ``shards`` rows
    rows = written(rows.join(large, "grp", "left").withColumn(
        "piece", F.coalesce(F.pmod(F.xxhash64("row"), "pieces"), F.lit(0).cast("long"))).drop("pieces"), "units")
    units = written(rows.groupBy("grp", "piece").agg(
        F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "vectors")
    parts = min(MOST_PARTS, max(1, -(-units.count() // UNITS)))
    part = F.pmod(F.xxhash64("grp", "piece"), F.lit(parts)).alias("part")
    binned = written(units.select(part, "grp", "piece", "bytes", "tokens", "rows").repartition(parts, "part")
                     .sortWithinPartitions("part", "grp", "piece").mapInArrow(
        _packed(shards), "part long, grp long, piece long, bytes long, tokens long, rows long, bin int"), "bins")
    # at most MOST_PARTS * shards rows
    bins = binned.groupBy("part", "bin").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"),
                                             F.sum("rows").alias("rows")).orderBy("part", "bin").collect()
    at = pack(np.array([[b["bytes"], b["tokens"], b["rows"]] for b in bins], float).reshape(-1, 3), shards)
    plan = docs.sparkSession.createDataFrame([(b["part"], b["bin"], int(s)) for b, s in zip(bins, at)],
                                             "part long, bin int, shard int")
    placed = binned.join(F.broadcast(plan), ["part", "bin"]).select("grp", "piece", "shard")
    dealt = rows.join(placed, ["grp", "piece"]) \
        .withColumn("lane", F.pmod(F.xxhash64("row"), F.lit(SLOT_LANES)).cast("int"))

    lanes = dealt.groupBy("shard", "lane").agg(F.count("*").alias("n"))   # shards * SLOT_LANES rows
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    start = lanes.select("shard", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "lane").orderBy("row")
    return dealt.withColumn("k", F.row_number().over(own) - 1) \
        .join(F.broadcast(start), ["shard", "lane"]) \
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                (F.col("first") + F.col("k")).cast("long").alias("slot"),
                F.lit(None).cast("int").alias("grown_shard"))
