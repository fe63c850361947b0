"""Near-duplicate documents by circulant MinHash.

A document's set: distinct shingles of five words (A-Z lower-cased, words cut at
x20 and x09-x0D); with fewer words the whole sequence as one shingle; without
words the set is empty and links with nothing.  Documents with
100 * intersection >= 75 * union are linked; links are confirmed on full sets
of 64-bit shingle hashes.

Circulant MinHash (C-MinHash): one permutation scatters the shingles over a
table of 2**20 places, a second one, circularly shifted by k places, gives
signature coordinate k.  24 bands of 3 coordinates find a pair at the limit
with probability 1 - (1 - 0.75**3)**24, about 0.999998.

Documents with equal sets are one class; only class representatives are banded
and compared, so large groups of copies cost one row each in a grouped minimum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .links import colliding, linked
from .store import text_mark, without, written

PLACES = 1 << 20
BANDS, ROWS = 24, 3
NUM, DEN = 75, 100
_CHUNK = 1 << 14

_ring: list[np.ndarray] = []


def _shifted() -> np.ndarray:
    """View whose row i holds the second permutation at places i, i+1, ...
    (circularly): the coordinates of a shingle at place i."""
    if not _ring:
        second = np.random.default_rng(2021).permutation(PLACES).astype(np.int32)
        k = BANDS * ROWS
        _ring.append(np.lib.stride_tricks.sliding_window_view(
            np.concatenate([second, second[:k - 1]]), k))
    return _ring[0]


def signatures(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, BANDS * ROWS) signature; texts without shingles get the maximum."""
    ring = _shifted()
    place = (kernel.mix(values ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(44)).astype(np.int64)
    out = np.full((len(offs) - 1, ring.shape[1]), PLACES, np.int32)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    for lo in range(0, len(place), _CHUNK):
        part, own = place[lo:lo + _CHUNK], text[lo:lo + _CHUNK]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        least = np.minimum.reduceat(ring[part], first, axis=0)
        out[own[first]] = np.minimum(out[own[first]], least)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(texts, BANDS) 64-bit keys."""
    s = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
    for r in range(ROWS):
        key = key * np.uint64(0x9FB21C651E98DF25) + s[:, :, r]
    return kernel.mix(key)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, buf, offs in kernel.text_blocks(batch.column(1)):
            flat, at = kernel.distinct_sets(*kernel.shingle_hashes(*kernel.word_hashes(buf, offs)))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat, dtype=np.uint64)])
            other = np.concatenate([np.zeros(1, np.uint64),
                                    np.cumsum(kernel.mix(flat + np.uint64(99)), dtype=np.uint64)])
            n = np.diff(at)
            keys = band_keys(signatures(flat, at))
            some = n > 0
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(n.astype(np.int64)),
                 pa.array((sums[at[1:]] - sums[at[:-1]]).view(np.int64)),
                 pa.array((other[at[1:]] - other[at[:-1]]).view(np.int64)),
                 kernel.list_array(keys[some].ravel(),
                                   np.concatenate([[0], np.cumsum(some * BANDS)])),
                 *[c.slice(lo, hi - lo) for c in batch.columns[2:]]],
                names=["doc_id", "n_shingles", "h1", "h2", "keys", *batch.schema.names[2:]])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in kernel.text_blocks(batch.column(1)):
            flat, at = kernel.distinct_sets(*kernel.shingle_hashes(*kernel.word_hashes(buf, offs)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), kernel.list_array(flat, at)],
                names=["id", "items"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id,
    text; other columns are ignored).

    Null or blank texts: no shingles, component of their own, kept.  Rows that
    share a doc_id are one document: a link of any of its texts counts.  A null doc_id never
    names a component while a copy with an id exists; alone it is kept with a
    null component.  An empty table gives an empty result.
    """
    return _decided(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


def _decided(own: DataFrame, carried: str = "") -> DataFrame:
    """:func:`near_duplicates` of (doc_id, text), with further columns of the
    types ``carried`` passed through.  Rows equal in doc_id and text are decided
    alike."""
    more = own.columns[2:]
    sketch = written(own.mapInArrow(
        _sketch, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>" + carried), "sketch")
    # written, so that the joins below read it afresh and a large class is split
    classes = written(sketch.filter("n_shingles > 0").groupBy("h1", "h2", "n_shingles")
                      .agg(F.min("doc_id").alias("id")), "classes")
    heads = classes.filter("id is not null")
    rows = sketch.filter("n_shingles > 0").join(heads, ["h1", "h2", "n_shingles"]) \
        .filter("doc_id = id").select("id", "keys")
    buckets = rows.select("id", F.explode("keys").alias("key"))
    members = colliding(buckets)
    wanted = written(members.select(F.col("id").alias("doc_id")).distinct(), "wanted")
    sets = written(own.select("doc_id", "text").join(wanted, "doc_id", "left_semi").mapInArrow(
        _sets, "id long, items array<long>"), "sets")
    roots = linked(members, sets, NUM, DEN)
    named = classes.join(roots, "id", "left") \
        .select("h1", "h2", "n_shingles", F.coalesce("root", "id").alias("class_root"))
    return sketch.drop("keys").join(named, ["h1", "h2", "n_shingles"], "left") \
        .select("doc_id", "n_shingles",
                F.when(F.col("n_shingles") > 0, F.col("class_root"))
                .otherwise(F.col("doc_id")).alias("component_id"), *more) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps.  A row goes by its
    id and its text, not with other rows of its id."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_mark(docs["text"]).alias("mark"))
    return without(docs, written(_decided(own, ", mark long").filter("not kept")
                                 .select("doc_id", "mark").distinct(), "gone"))
