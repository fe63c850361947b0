"""Embedding near-dedup by collision-counting projections.

Vectors are compared only within a label.  Every vector, scaled to length one,
is projected on ``M`` Gaussian directions.  For each direction the values are
sorted, and a window of half-width ``HALF`` centred at a query's value collects
the vectors it collides with; a pair's collisions are counted over all
directions.  For a pair at cosine 0.98 the distance on a direction is normal
with deviation ``DEVIATION`` = sqrt(2 - 2 * 0.98) = 0.2, so its count is binomial,
and the count asked for is the largest that such a pair reaches with probability
1 - ``MISS``.  Pairs that reach it are verified by their cosine in double precision.

The pairs to count come out of sorted windows too: those of the first direction,
``WIDE`` = 4.9 deviations to each side.  A pair that has missed too many windows
isn't counted further, so counts are kept only for pairs that may still reach
the limit.

A window on one direction holds a fixed share of all vectors, so the sorted lists
are cut: a list holds the vectors that share ``k`` cells of width ``WIDTH`` on
directions of its own.  ``tables(k)`` such cuts, each with new directions, bring
a pair at the limit together in at least one list with probability 1 - ``MISS``.
``k`` is the cheapest for the label's size and for the share of pairs that one
cell keeps, both measured over all its vectors; ``k`` = 0 is one list.  A pair is
counted in the first cut only that brings it together.

Equal vectors are one class with a weight.  A list of more than ``BLOCK`` classes is
compared block against block, each pair of blocks a group of its own; shorter lists are
bundled.  A group returns sums and a spanning forest, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import kernel
from .components import components
from .store import written

COSINE = 0.98
DEVIATION = math.sqrt(2 - 2 * COSINE)
M = 32
HALF = 0.7
WIDE = 0.98
WIDTH = 1.6
MOST_CELLS = 15
PROBES = 8
BLOCK = 4096
BUNDLE = 16384
#: Pairs that windows emit at a time.
EMIT = 1 << 17
#: Moving a vector to a list, or to a pair of blocks of one, costs about as much as
#: counting so many pairs (measured).
MOVE = 1024
MISS = 1e-6


def least_count() -> int:
    """Largest count that a pair at the limit reaches with probability 1 - MISS."""
    p = math.erf(HALF / DEVIATION / math.sqrt(2))
    below = 0.0
    for c in range(M + 1):
        below += math.comb(M, c) * p ** c * (1 - p) ** (M - c)
        if below > MISS:
            return c
    return M


def same_cell() -> float:
    """Probability that a pair at the limit shares a cell of a shifted grid."""
    t = WIDTH / DEVIATION
    return math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


def tables(k: int) -> int:
    """Cuts of k cells that bring a pair at the limit together with probability 1 - MISS."""
    return math.ceil(math.log(MISS) / math.log1p(-same_cell() ** k)) if k else 1


def cells_for(n: Column, share: Column) -> Column:
    """The cheapest k for n vectors when a cell keeps ``share`` of their pairs."""
    def cost(k):
        held = n * F.pow(share, F.lit(k))             # by the list of a vector
        return F.lit(tables(k)) * (held + MOVE * F.greatest(F.lit(1.0), held / BLOCK))
    return F.array_min(F.array(*[F.struct(cost(k).alias("cost"), F.lit(k).alias("k"))
                                 for k in range(MOST_CELLS + 1)]))["k"]


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, M))


def grid(dim: int, k: int, cuts: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and shifts of the cells of ``cuts`` cuts."""
    rng = np.random.default_rng([dim, k])
    return rng.standard_normal((dim, k * cuts)), rng.uniform(0, WIDTH, k * cuts)


def cut_keys(x: np.ndarray, k: int) -> np.ndarray:
    """(rows, tables(k)) names of the lists of unit vectors x."""
    cuts = tables(k)
    g, shift = grid(x.shape[1], k, cuts)
    cells = np.floor((x @ g + shift) / WIDTH).astype(np.int64).reshape(len(x), cuts, k)
    key = np.zeros((len(x), cuts), np.uint64)
    for j in range(k):
        key = kernel.mix(key + cells[:, :, j].view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return (key >> np.uint64(33)).astype(np.int32)


def windows(line: np.ndarray, group: np.ndarray, half: float):
    """Rows sorted by value, one stretch a group, and for each row the places lo
    (inclusive) and hi of the window around its value in its own group."""
    span = line.max() - line.min() + 2 * half + 1
    at = line - line.min() + group * span
    order = np.argsort(at, kind="stable")
    return order, np.searchsorted(at[order], at - half, "left"), np.searchsorted(at[order], at + half, "right")


def candidates(p: np.ndarray, group: np.ndarray, side: np.ndarray):
    """Pairs (i, j) of rows of one group whose collisions reach the least count, in parts
    of bounded memory.  p holds projections; side 2 is compared with itself, each pair
    once, else side 0 with side 1."""
    order, lo, hi = windows(p[:, 0], group, WIDE)
    # rows by place on the first direction, so that its windows are ranges
    lo, hi, side = lo[order], hi[order], side[order]
    lo = np.where(side == 2, np.arange(1, len(p) + 1), lo)
    lo[side == 1] = hi[side == 1]                     # side 0 asks for them
    narrow = []
    for j in range(p.shape[1]):
        there, low, high = windows(p[order, j], group[order], HALF)
        place = np.empty(len(p), np.uint32)
        place[there] = np.arange(len(p), dtype=np.uint32)
        narrow.append((place, low.astype(np.uint32), (high - low).astype(np.uint32)))
    allowed = p.shape[1] - least_count()
    size = hi - lo
    ends = np.cumsum(size)
    start = 0
    while start < len(order):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + EMIT, "right")))
        own = size[start:stop]
        i = np.repeat(np.arange(start, stop, dtype=np.int32), own)
        j = (np.arange(len(i)) + np.repeat(lo[start:stop] - (np.cumsum(own) - own), own)).astype(np.int32)
        if (side != 2).any():
            i, j = i[side[i] != side[j]], j[side[i] != side[j]]
        missed = np.zeros(len(i), np.int8)
        for place, low, width in narrow:
            missed += place[j] - low[i] >= width[i]   # wraps below low
            alive = np.flatnonzero(missed <= allowed)
            if 4 * len(alive) < 3 * len(i):
                i, j, missed = i[alive], j[alive], missed[alive]
        alive = missed <= allowed
        yield order[i[alive]], order[j[alive]]
        start = stop


def _unit(vectors) -> np.ndarray:
    x = np.array(list(vectors), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Root (smallest row) of each of n rows under links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _earlier(keys: np.ndarray, cut: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs that an earlier cut brought together."""
    before = np.arange(keys.shape[1])[None, :] < cut[i][:, None]
    return ((keys[i] == keys[j]) & before).any(axis=1)


def count_lists(part: pd.DataFrame) -> pd.DataFrame:
    """Links within the lists (cut, key) of one group: per class the linked weight and the
    smallest class it is connected to here."""
    part = part.sort_values(["id", "cut"], ignore_index=True)
    ids = part["id"].to_numpy()
    cut = part["cut"].to_numpy()
    group = np.unique(np.stack([cut, part["key"].to_numpy()]), axis=1, return_inverse=True)[1].ravel()
    x = _unit(part["v"])
    keys = np.array(list(part["keys"]), np.int32)
    links, roots = np.zeros(len(part), np.int64), np.arange(len(part))
    weight = part["n"].to_numpy()
    for i, j in candidates(x @ directions(x.shape[1]), group, part["side"].to_numpy()):
        for at in range(0, len(i), 1 << 16):          # bounded memory
            a, b = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
            good = (x[a] * x[b]).sum(axis=1) >= COSINE
            a, b = a[good], b[good]
            new = ~_earlier(keys, cut, a, b)
            a, b = a[new], b[new]
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            tied = np.arange(len(part))
            roots = _forest(len(part), np.concatenate([a, tied]), np.concatenate([b, roots]))
    has = links > 0
    return pd.DataFrame({"id": ids[has], "links": links[has], "root": ids[roots][has]})


def by_size(vectors: pd.Series, out: list, fn, *more: pd.Series) -> pd.Series:
    """fn over the unit vectors of each size (and value of the other series), put into out."""
    by = [vectors.map(len), *more]
    for value, at in vectors.groupby(by).indices.items() if len(vectors) else ():
        made = fn(_unit(vectors.iloc[at]), *(value[1:] if isinstance(value, tuple) else ()))
        for r, m in zip(at, made):
            out[r] = m
    return pd.Series(out, dtype=object)


@F.pandas_udf(ArrayType(IntegerType()))
def probe_cells(v: pd.Series) -> pd.Series:
    """The cells of a vector on PROBES directions."""
    def cells(x):
        g, shift = grid(x.shape[1], PROBES, 1)
        return np.floor((x @ g + shift) / WIDTH).astype(np.int32)
    return by_size(v, [None] * len(v), cells)


@F.pandas_udf(ArrayType(IntegerType()))
def list_keys(v: pd.Series, k: pd.Series) -> pd.Series:
    return by_size(v, [None] * len(v), lambda x, k: cut_keys(x, int(k)), k)


def embedding_links(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row (vec_id, embedding,
    label; other columns are ignored).

    Vectors that are null, empty, zero or hold null or non-finite components,
    vectors with a null label or a null id, and vectors of different lengths
    link with nothing.  Repeated rows count as one vector; each has its row.
    Cosines equal to the limit are links.  An empty table gives an empty result.
    """
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"),
                         F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) \
        & F.exists("v", lambda c: c != 0)
    rows = own.filter(F.coalesce(usable, F.lit(False))).distinct()
    classes = written(rows.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
                      .withColumn("dim", F.size("v")), "classes")

    group = ["label", "dim"]
    probed = classes.select(*group, F.posexplode(probe_cells("v")).alias("probe", "cell")) \
        .groupBy(*group, "probe", "cell").agg(F.count("*").cast("double").alias("m"))
    sizes = probed.groupBy(*group).agg((F.sum("m") / PROBES).alias("size"),
                                       (F.sum(F.col("m") * F.col("m")) / PROBES).alias("pairs")) \
        .select(*group, "size", cells_for(F.col("size"), F.col("pairs") / (F.col("size") * F.col("size"))).alias("k"))
    keyed = written(classes.join(written(sizes, "sizes"), group).withColumn("keys", list_keys("v", "k")), "keyed")

    listed = [*group, "cut", "key"]
    lists = written(keyed.select(*group, F.posexplode("keys").alias("cut", "key")).groupBy(*listed)
                    .agg(F.count("*").alias("m")).filter("m > 1")
                    .withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")), "lists")
    # a list in one block joins a bundle; bundles are as many as their rows ask for
    bundles = F.ceil(F.col("size") * F.size("keys") / BUNDLE).cast("int")
    dealt = keyed.select(*group, "id", "n", "v", "keys", bundles.alias("bundles"),
                         F.posexplode("keys").alias("cut", "key")).join(lists, listed)
    b, o = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.col("o")
    small = dealt.filter("blocks = 1").withColumn(
        "task", F.struct(F.lit(-1).alias("cut"), F.pmod(F.xxhash64("cut", "key"), F.col("bundles")).cast("int").alias("key"),
                         F.lit(0).alias("one"), F.lit(0).alias("two"))) \
        .withColumn("side", F.lit(2))
    large = dealt.filter("blocks > 1").withColumn("b", b) \
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumn("task", F.struct("cut", "key", F.least("b", o).alias("one"), F.greatest("b", o).alias("two"))) \
        .withColumn("side", F.when(F.col("b") == o, 2).when(F.col("b") < o, 0).otherwise(1))
    cols = [*group, "task", "side", "cut", "key", "id", "n", "v", "keys"]
    found = written(small.select(*cols).union(large.select(*cols)).groupBy(*group, "task")
                    .applyInPandas(lambda part: count_lists(part), "id long, links long, root long"), "found")
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.select("label", "v", "id", "n").join(sums, "id", "left").join(roots, "id", "left") \
        .select("label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
                F.coalesce("root", "id").alias("root"))
    flagged = own.withColumn("ok", F.coalesce(usable, F.lit(False)))
    key = F.col("ok") & (F.col("a.label") == F.col("b.label")) & (F.col("a.v") == F.col("b.v"))
    return flagged.alias("a").join(named.alias("b"), key, "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "vec_id").alias("component_id")) \
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
