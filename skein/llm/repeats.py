"""Repeated passages by exact windows at shared minimisers.

A passage is a run of at least ``LEAST`` = 50 words (A-Z lower-cased, words cut
at x20 and x09-x0D) that also stands in another document.  A window of 50 words
has 35 grams of 16 words; the place of its smallest one (the first, on ties) owns
it.  The owner depends on the window's words alone, so all copies of a window are
owned by the same gram at the same place in them.

Owners whose gram stands in one document only are set aside by a grouped count.
The windows of each of the others are consecutive and are hashed one by one.
Owners with the same windows are one group: if it holds two documents, all its
windows are passages.  One member of each group hands on its windows, which are
counted by hash, so that any two equal windows of different documents meet,
whatever stands around them; this settles the windows of the groups of one
document.  Windows of a document that overlap are merged.

Documents with the same sequence of words are one class; only the first is
searched, and each of them is a passage as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .store import written

LEAST, GRAM = 50, 16
RUN = LEAST - GRAM + 1


def owners(grams: np.ndarray) -> np.ndarray:
    """Position of the smallest gram (the first, on ties) of each run of RUN."""
    if len(grams) < RUN:
        return np.zeros(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(grams, RUN)
    return np.concatenate([lo + np.arange(len(part)) + part.argmin(axis=1)
                           for lo, part in ((lo, runs[lo:lo + 65536]) for lo in range(0, len(runs), 65536))])


def selected(grams: np.ndarray) -> np.ndarray:
    """Positions that own a window."""
    return np.unique(owners(grams))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in kernel.text_blocks(batch.column(1)):
            words, at = kernel.word_hashes(buf, offs)
            grams = kernel.gram_hashes(words, GRAM)
            place = np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(
                kernel.mix(words + place.astype(np.uint64) * np.uint64(seed)), dtype=np.uint64)])
                for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
            found = [selected(grams[a:max(a, b - GRAM + 1)]) for a, b in zip(at[:-1], at[1:])]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            first = np.repeat(at[:-1], np.diff(ends))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at).astype(np.int64)),
                 *[pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64)) for s in sums],
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(grams[flat + first].view(np.int64))),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))],
                names=["doc_id", "n_words", "h1", "h2", "grams", "places"])


WINDOWS = "doc_id long, start int, windows array<long>, same long"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per wanted place the first of the windows it owns, their hashes, and a
    hash of them all."""
    for batch in batches:
        for lo, hi, buf, offs in kernel.text_blocks(batch.column(1)):
            words, at = kernel.word_hashes(buf, offs)
            grams, whole = kernel.gram_hashes(words, GRAM), kernel.gram_hashes(words, LEAST)
            places = batch.column(2).slice(lo, hi - lo)
            texts, starts, parts = [], [], []
            for t, (a, b) in enumerate(zip(at[:-1], at[1:])):
                own = owners(grams[a:max(a, b - GRAM + 1)])
                here = np.flatnonzero(np.isin(own, places[t].values.to_numpy(zero_copy_only=False)))
                texts.append(np.full(len(here), t))
                starts.append(here)
                parts.append(np.stack([own[here], whole[a + here].view(np.int64)]))
            text, start = np.concatenate(texts), np.concatenate(starts)
            own, value = np.concatenate(parts, axis=1)
            if not len(start):
                continue
            first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])]))
            ends = np.concatenate([first, [len(start)]])
            step = (np.arange(len(start)) - np.repeat(first, np.diff(ends))).astype(np.uint64)
            value = value.view(np.uint64)
            same = np.add.reduceat(kernel.mix(value + step * np.uint64(0x9E3779B97F4A7C15)), first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo).take(pa.array(text[first])),
                 pa.array(start[first].astype(np.int32)), kernel.list_array(value, ends),
                 pa.array(kernel.mix(same).view(np.int64))],
                names=["doc_id", "start", "windows", "same"])


def _passages(rows: DataFrame) -> DataFrame:
    """Spans (doc_id, start, end, other) of the windows that stand in several
    documents."""
    other = F.when(F.col("doc_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("other")
    # written, so that the joins read them afresh and a very common key is split
    groups = written(rows.groupBy("same").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "groups")
    known = written(rows.join(groups, "same").withColumn("one", F.col("doc_id") == F.col("lo")), "known")
    common = written(known.filter("one").select(F.explode("windows").alias("window"), "lo", "hi")
                     .groupBy("window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                     .filter("lo <> hi"), "common")
    single = known.filter("lo = hi").select("doc_id", "start", F.posexplode("windows").alias("step", "window")) \
        .withColumn("start", F.col("start") + F.col("step"))
    return known.filter("lo <> hi").select(
        "doc_id", "start", (F.col("start") + F.size("windows") + LEAST - 1).alias("end"), other) \
        .union(single.join(common, "window").select(
            "doc_id", "start", (F.col("start") + LEAST).alias("end"), other))


def _merged(spans: DataFrame) -> DataFrame:
    """Overlapping spans of a document as one; a document's spans are bounded by
    its length."""
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int")
    return spans.distinct().withColumn("new", new).withColumn("island", F.sum("new").over(order)) \
        .groupBy("doc_id", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"),
                                         F.min("other").alias("other_doc_id")) \
        .drop("island")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), other_doc_id: one row per
    maximal run of words of a document that is covered by passages standing in
    other documents; other_doc_id is one of them.

    Documents of fewer than 50 words, null and empty texts have no row.  Rows
    that share a doc_id are one document and rows without an id none.  Other
    columns are ignored; an empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    rows = written(own.mapInArrow(
        _anchors, "doc_id long, n_words long, h1 long, h2 long, grams array<long>, places array<int>")
        .filter(F.col("n_words") >= LEAST), "anchors")
    whole = ["h1", "h2", "n_words"]
    classes = written(rows.groupBy(*whole).agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail")),
                      "classes")
    heads = rows.join(classes.select(*whole, "head"), whole).filter("doc_id = head")
    anchors = heads.select("doc_id", F.explode(F.arrays_zip("grams", "places")).alias("a")) \
        .select("doc_id", F.col("a.grams").alias("gram"), F.col("a.places").alias("place"))
    # written, so that the join reads it afresh and a very common gram is split
    shared = written(anchors.groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                     .filter("lo <> hi").select("gram"), "shared")
    wanted = written(anchors.join(shared, "gram", "left_semi").groupBy("doc_id")
                     .agg(F.sort_array(F.collect_set("place")).alias("places")), "wanted")
    windows = written(own.join(wanted, "doc_id").select("doc_id", "text", "places")
                      .mapInArrow(_windows, WINDOWS), "windows")
    spans = _passages(windows)
    copies = classes.filter("head <> tail")
    members = rows.join(copies, whole).select(
        "doc_id", F.lit(0).alias("start_word"), F.col("n_words").cast("int").alias("end_word"),
        F.when(F.col("doc_id") == F.col("head"), F.col("tail")).otherwise(F.col("head"))
        .alias("other_doc_id")).distinct()
    part = _merged(spans).join(members.select("doc_id"), "doc_id", "left_anti")
    return part.select("doc_id", "start_word", "end_word", "other_doc_id").union(members)
