"""Conversation prefix trie, rolled up band by band.

A node is a distinct sequence of first turns.  Nothing of a conversation is held
in one place: its turns are numbered after a range sort of all turns, and a prefix
is named by its depth and the exclusive or of two 64-bit hashes of (position,
digest of the turn), a running value that is taken inside blocks of ``HEIGHT``
turns and carried over blocks of blocks.

The smallest conversation of a node stands for it.  Subtree sums use the
depth-band rollup.  Depths are cut into bands of ``HEIGHT``:

1. every node explodes to its ancestors inside its band, which gives sums over the
   part of its subtree that lies in the band;
2. the tops of the bands form a trie ``HEIGHT`` times less deep, whose nodes carry
   those sums; it is rolled up the same way, so tops get whole subtree sums;
3. the completed sum of every top below the first band explodes to the ancestors
   in the band above it.

So a node makes at most ``HEIGHT`` rows a level, and there are log(depth) to the
base ``HEIGHT`` levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Depths a band; a path inside a band has at most as many nodes.
HEIGHT = 64
#: Ids of one piece of a list of members; pieces are put together in order.
PIECE = 4096
#: A conversation takes its first turns from the first one of its hundred, up to five.
FAMILY, SHARED = 100, 6

KEY = ["depth", "p1", "p2"]


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn digest and code points of every turn.

    Turns are sorted over all partitions, so a long conversation spans several;
    a position is the place in its partition plus the conversation's turns in the
    partitions before.
    """
    text, role = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "role"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row")) \
        .filter("conv_id is not null").repartitionByRange(n, *order, "row").sortWithinPartitions(*order, "row")
    digest = F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256))
    rows = written(rows.select("conv_id", digest.alias("digest"), F.length("text").cast("long").alias("chars"),
                               F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")),
                   "turns")
    here = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    here = here.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    return rows.join(here, ["conv_id", "part"]) \
        .select("conv_id", (F.col("at") - F.col("first") + F.col("skip") + 1).alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, depth, digest, chars: turns of the rebuilt conversations, and a
    row of depth 0 for each.  A conversation's first turns come from the first
    conversation of its family; there are less than ``SHARED`` of them."""
    sizes = written(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    share = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(SHARED))
    convs = sizes.select("conv_id", share.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("head"))
    heads = sizes.select(F.col("conv_id").alias("head"), F.col("n").alias("n_head"))
    convs = written(convs.join(heads, "head", "left").select(
        "conv_id", "head", "h", F.least("h", F.coalesce("n_head", F.lit(0))).alias("taken")), "families")
    first = turns.filter((F.col("pos") < SHARED) & (F.col("conv_id") % FAMILY == 0)) \
        .withColumnRenamed("conv_id", "head")
    lent = convs.join(first, "head").filter("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "digest", "chars")
    own = turns.join(convs, "conv_id").filter("pos > h") \
        .select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "digest", "chars")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"),
                        F.lit(0).cast("long").alias("chars"))
    return lent.unionByName(own).unionByName(root)


def _running(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, d, x1, x2, ...) with the exclusive or of x1 and of x2
    over the rows of the conversation up to d; d is whole and has no gaps."""
    rows = rows.withColumn("block", F.floor(F.col("d") / HEIGHT))
    here = Window.partitionBy("conv_id", "block").orderBy("d")
    inside = written(rows.withColumns({x: F.bit_xor(x).over(here) for x in ("x1", "x2")}), "running")
    if not inside.filter("block > 0").limit(1).count():
        return inside.drop("block")
    # what a block ends with, one block later
    ends = inside.groupBy("conv_id", "block").agg(*(F.max_by(x, "d").alias(x) for x in ("x1", "x2")))
    carry = _running(ends.withColumnRenamed("block", "d")) \
        .select("conv_id", (F.col("d") + 1).alias("block"), F.col("x1").alias("c1"), F.col("x2").alias("c2"))
    return written(inside.join(carry, ["conv_id", "block"], "left").withColumns(
        {f"x{i}": F.col(f"x{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0).cast("long"))) for i in (1, 2)})
        .drop("block", "c1", "c2"), "carried")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, p1, p2 (name of the prefix), q1, q2 (name of the one that is
    a turn shorter) and chars, for every prefix of every conversation."""
    mark = [F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "digest")).otherwise(0)
            for seed in ("left", "right")]
    rows = turns.select("conv_id", F.col("depth").alias("d"), "chars", mark[0].alias("x1"), mark[1].alias("x2"),
                        mark[0].alias("own1"), mark[1].alias("own2"))
    return _running(rows).select("conv_id", F.col("d").alias("depth"), "chars",
                                 F.col("x1").alias("p1"), F.col("x2").alias("p2"),
                                 F.col("x1").bitwiseXOR(F.col("own1")).alias("q1"),
                                 F.col("x2").bitwiseXOR(F.col("own2")).alias("q2"))


def _path(name: str) -> Column:
    """The names of a conversation's prefixes inside a band, from its top."""
    return F.array_sort(F.collect_list(F.struct("d", *KEY))).alias(name)


def _total(values: Column, name: str) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda total, x: total + x[name]).alias(name)


def _tops(rows: DataFrame) -> DataFrame:
    """The rows of the tops of bands, as rows of a trie that is less deep."""
    return rows.filter(F.col("d") % HEIGHT == 0).withColumn("d", F.floor(F.col("d") / HEIGHT))


def subtree_sums(paths: DataFrame, nodes: DataFrame, sums: list[str]) -> DataFrame:
    """KEY and the sums of ``sums`` over each node's subtree, its top included.

    ``paths`` has conv_id, d and KEY for every prefix of (at least) the
    conversations that stand for a node, ``nodes`` conv_id, d, KEY and ``sums``.
    """
    band = F.floor(F.col("d") / HEIGHT).alias("band")
    bands = written(paths.groupBy("conv_id", band).agg(_path("path")), "bands")
    own = nodes.groupBy("conv_id", band).agg(F.collect_list(F.struct("d", *sums)).alias("own"))
    # one row per ancestor: the nodes below it on this conversation's path are added up first
    exploded = own.join(bands, ["conv_id", "band"]).select("own", F.explode("path").alias("up"))
    below = F.filter("own", lambda x: x["d"] >= F.col("up")["d"])
    exploded = exploded.select(*(F.col("up")[k].alias(k) for k in ["d", *KEY]), *(_total(below, s) for s in sums))
    inside = written(exploded.filter(F.greatest(*sums) > 0).groupBy("d", *KEY).agg(*(F.sum(s).alias(s) for s in sums)),
                     "inside")
    if not nodes.filter(F.col("d") >= HEIGHT).limit(1).count():
        return inside.drop("d")
    tops = _tops(nodes).drop(*sums).join(inside.drop("d"), KEY, "left").fillna(0, sums)
    tops = written(tops, "tops")
    whole = subtree_sums(_tops(paths), tops, sums)
    above = tops.drop(*sums).filter("d > 0").join(whole, KEY) \
        .select("conv_id", (F.col("d") - 1).alias("band"), *sums) \
        .groupBy("conv_id", "band").agg(*(F.sum(s).alias(s) for s in sums))
    lifted = above.join(bands, ["conv_id", "band"]).select(F.explode("path").alias("up"), *sums) \
        .select(*(F.col("up")[k].alias(k) for k in KEY), *sums)
    return written(inside.drop("d").unionByName(lifted).groupBy(*KEY).agg(*(F.sum(s).alias(s) for s in sums)), "sums")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest for each run of equal KEY; the pieces come in order."""
    name, running = None, hashlib.sha256()

    def ready() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*(pa.array([v], pa.int64()) for v in name), pa.array([running.hexdigest()])], names=[*KEY, "ends_sha256"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != name:
                if name is not None:
                    yield ready()
                name, running = row[:3], hashlib.sha256(row[4].encode())
            else:
                running.update(("," + row[4]).encode())
    if name is not None:
        yield ready()


def _ends(rows: DataFrame) -> DataFrame:
    """KEY and ends_sha256: digests of the sorted ids of the conversations that end
    at a node.  Ids are joined in pieces of at most ``PIECE``; the pieces of a node
    are read in order by one task, which keeps a running digest alone."""
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct(*KEY), "depth").alias("end"))
    pieces = last.groupBy(*(F.col("end")[k].alias(k) for k in KEY), F.floor(F.col("conv_id") / PIECE).alias("piece")) \
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
             .alias("ids"))
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece") \
        .mapInArrow(_digests, "depth long, p1 long, p2 long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``turns`` has conv_id, turn, role and text.  Turns are ordered by turn, nulls
    first; those of one turn by role, then by text.  A null role or text is empty;
    rows without a conv_id belong to no conversation.  Repeated rows are turns of
    their own, other columns are ignored, and an empty table has no node.

    conv_id: smallest member; depth; parent_conv_id (null at the root); n_convs;
    n_children; n_leaves; saved_tokens; ends_sha256.
    """
    rows = prefixes(rebuilt(written(numbered(turns), "numbered")))
    nodes = written(rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"),
        F.max("q1").alias("q1"), F.max("q2").alias("q2")), "nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    children = nodes.filter("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, KEY, "left").fillna(0, ["n_children"]), "nodes-children")
    sums = subtree_sums(
        rows.select("conv_id", F.col("depth").alias("d"), *KEY),
        nodes.select("conv_id", F.col("depth").alias("d"), *KEY,
                     (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                     ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")),
        ["n_leaves", "saved_tokens"])
    parents = nodes.select(F.col("depth").alias("up_depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
                           F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.withColumn("up_depth", F.col("depth") - 1).join(parents, ["up_depth", "q1", "q2"], "left")
    return nodes.join(sums, KEY, "left").join(written(_ends(rows), "ends"), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
