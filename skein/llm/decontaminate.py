"""Benchmark decontamination: containment search with size-partitioned MinHash.

An item is found in a document when the document holds at least 75 % of the
item's distinct five-word shingles (words as in :mod:`near_dup`).  An item of fewer
words has its whole sequence as one shingle; where there are items of n < 5 words,
the runs of n words of a document count among its shingles, so such an item is found
wherever it stands.

Documents are partitioned by the size of their shingle sets: partition p holds
sets of up to 2**p shingles.  A containment limit corresponds to a Jaccard
limit that falls with the size of the document, so every partition gets its own
MinHash: one permutation of the 64-bit shingle hashes, cut into 2**(p + f) bins,
of which each keeps its smallest value.  An item is sketched with the same bins
for each partition it can be contained in; one equal bin makes a candidate.
``f`` is tuned to the smallest item so that a pair at the limit is missed with
a probability of at most 2**-20.  Long documents thus get long signatures, and
a short item inside one still collides.

Candidates are verified exactly: the distinct shingles that a document shares
with any item travel with its sketch (a fixed-size bit table keeps all others
back), and are intersected with the item's set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .store import text_mark, without, written

NUM, DEN = 75, 100
#: Bits of the table of item shingles; its size does not depend on any input.
TABLE_BITS = 1 << 22


def _least_shared(n: int) -> int:
    return -(-n * NUM // DEN)


def _entries(extra_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in kernel.text_blocks(batch.column(1)):
                words, word_at = kernel.word_hashes(buf, offs)
                flat, at = kernel.distinct_sets(*kernel.shingle_hashes(words, word_at))
                least = np.zeros(len(flat), np.int32)
                for a, b in zip(at[:-1], at[1:]):
                    if a == b:
                        continue
                    # a value is the smallest of its bin once the bin's bits
                    # go beyond what it shares with the value before it
                    apart = (flat[a + 1:b] ^ flat[a:b - 1]).astype(np.float64)
                    shared = 63 - np.floor(np.log2(apart)).astype(np.int64)
                    least[a + 1:b] = np.maximum(shared + 1 - extra_bits, 0)
                    size = int(np.ceil(np.log2(_least_shared(int(b - a)))))
                    least[a:b] = np.maximum(least[a:b], size)
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)),
                     kernel.list_array(flat, at),
                     pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(least)),
                     pa.array(np.diff(word_at).astype(np.int32))],
                    names=["item_id", "n_item", "items", "least", "n_words"])
    return run


def _shingles(buf: np.ndarray, offs: np.ndarray, short: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each text, and its runs of as many words as ``short`` names."""
    words, word_at = kernel.word_hashes(buf, offs)
    flat, at = kernel.shingle_hashes(words, word_at)
    if not short:
        return flat, at
    more = [(flat, at)] + [kernel.run_hashes(words, word_at, n) for n in short]
    text = np.concatenate([np.repeat(np.arange(len(a) - 1), np.diff(a)) for _, a in more])
    order = np.argsort(text, kind="stable")
    return np.concatenate([f for f, _ in more])[order], sum(a for _, a in more)


def _search(table: np.ndarray, extra_bits: int, short: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in kernel.text_blocks(batch.column(1)):
                flat, at = _shingles(buf, offs, short)
                bit = flat & np.uint64(TABLE_BITS - 1)
                hit = (table[(bit >> np.uint64(3)).astype(np.int64)]
                       >> (bit & np.uint64(7)).astype(np.uint8)) & 1
                count = np.add.reduceat(np.concatenate([hit, [0]]).astype(np.int64), at[:-1]) \
                    * (np.diff(at) > 0)
                rows, parts, sketches, hits = [], [], [], []
                for t in np.flatnonzero(count):
                    own = np.unique(flat[at[t]:at[t + 1]])
                    p = int(np.ceil(np.log2(len(own))))
                    bins = own >> np.uint64(max(64 - p - extra_bits, 0))
                    first = np.concatenate([[True], bins[1:] != bins[:-1]])
                    bit = own & np.uint64(TABLE_BITS - 1)
                    known = ((table[(bit >> np.uint64(3)).astype(np.int64)]
                              >> (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                    if (first & known).any():
                        rows.append(lo + t)
                        parts.append(p)
                        sketches.append(own[first & known].view(np.int64))
                        hits.append(own[known].view(np.int64))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), pa.array(parts, pa.int32()),
                         pa.array(sketches, pa.list_(pa.int64())),
                         pa.array(hits, pa.list_(pa.int64())),
                         *[c.take(pa.array(rows)) for c in batch.columns[2:]]],
                        names=["doc_id", "p", "sketch", "hits", *batch.schema.names[2:]])
    return run


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: one row per document and
    item found in it.  Other columns are ignored.

    Null or blank texts and items match nothing; an empty table on either side
    gives an empty result.  Repeated rows give one result row; where rows share
    an id, the highest count stands.  Ties at the limit are found.
    """
    return _matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items) \
        .groupBy("doc_id", "item_id").agg(F.max_by("n_item", "n_shared").alias("n_item"),
                                          F.max("n_shared").alias("n_shared")) \
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))


def _matches(own: DataFrame, items: DataFrame, carried: str = "") -> DataFrame:
    """doc_id, item_id, n_item, n_shared of each row of ``own`` (doc_id, text) and
    item found in it, with further columns of the types ``carried`` passed
    through."""
    more = own.columns[2:]
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    sized = "item_id long, n_item long, items array<long>, least array<int>, n_words int"
    smallest, short = asked.mapInArrow(_entries(0), sized).filter("n_item > 0") \
        .agg(F.min("n_item"), F.sort_array(F.collect_set(F.when(F.col("n_words") < 5, F.col("n_words"))))).head()
    extra = max(2, -(-20 // _least_shared(smallest or 1)) - 1)
    sets = written(asked.mapInArrow(_entries(extra), sized).filter("n_item > 0").drop("n_words").distinct(), "items")

    # at most TABLE_BITS / 32 rows, whatever the size of the benchmark
    bit = F.col("x").bitwiseAND(TABLE_BITS - 1)
    words = sets.select(F.explode("items").alias("x")) \
        .select(F.shiftright(bit, 5).alias("word"), bit.bitwiseAND(31).cast("int").alias("b")) \
        .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).collect()
    table = np.zeros(TABLE_BITS // 32, np.uint32)
    for w in words:
        table[w["word"]] = w["bits"]
    # the session's broadcast: TABLE_BITS / 8 bytes
    hits = written(own.mapInArrow(
        _search(table.view(np.uint8), extra, short),
        "doc_id long, p int, sketch array<long>, hits array<long>" + carried)
        .withColumn("row", F.monotonically_increasing_id()), "hits")

    entries = sets.select("item_id", F.explode(F.arrays_zip("items", "least")).alias("e")) \
        .select("item_id", F.col("e.items").alias("x"), F.col("e.least").alias("least"))
    found = hits.select("row", "p", F.explode("sketch").alias("x")).join(entries, "x") \
        .filter("p >= least").select("row", "item_id").distinct()
    common = F.size(F.array_intersect("hits", "items"))
    return found.join(hits.select("row", "doc_id", "hits", *more), "row") \
        .join(sets.select("item_id", "n_item", "items"), "item_id") \
        .select("doc_id", "item_id", "n_item", common.cast("long").alias("n_shared"), *more) \
        .filter(F.col("n_shared") * DEN >= F.col("n_item") * NUM)


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item.  A row goes by its id and its text,
    not with other rows of its id."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_mark(docs["text"]).alias("mark"))
    return without(docs, written(_matches(own, items, ", mark long").select("doc_id", "mark").distinct(), "leaks"))
