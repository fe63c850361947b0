"""Quality classifier: generalised additive model with pairwise interactions.

Features of a text (all from its bytes, in one vectorised pass) are cut into
bins.  Boosting goes round the features in turn: a shallow tree over one
feature's bins is fitted to the current residuals and its leaf values are added
to that feature's lookup table.  Then the pairs of features whose coarse grid
explains most of what is left get two-dimensional tables the same way.  A score
is the logistic of a sum of table entries: one addition per table.

The model is fitted on at most ``SAMPLE`` labelled documents (a documented
bound; those with the smallest hash of the id), so the tables and the fit on the
driver have a fixed size.  Labels with crc32(doc_id) mod 5 = 0 are held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

SAMPLE = 20_000
BINS, COARSE = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 60, 30, 4
RATE = 0.3
LIMIT = 0.3

FEATURES = ("log_words", "word_length", "upper", "digit", "odd", "bang", "bar", "point",
            "newline", "wide", "word_repeat", "gram_repeat", "line_length", "odd_words")

_KIND = {"upper": range(0x41, 0x5B), "digit": range(0x30, 0x3A),
         "odd": [*b"#$%&*@^~=+<>\\_{}[]/"], "bang": b"!", "bar": b"|", "point": b".,;:?",
         "newline": b"\n", "wide": range(0xC0, 0x100)}


def _flags(codes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


_TABLES = {name: _flags(codes) for name, codes in _KIND.items()}
_SYMBOL = _TABLES["odd"] | _TABLES["bang"] | _TABLES["bar"]


def _sums(flag: np.ndarray, offs: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(flag)])
    return (run[offs[1:]] - run[offs[:-1]]).astype(float)


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, features) of one block; empty texts have zeros."""
    words, at = kernel.word_hashes(buf, offs)
    starts, ends, _ = kernel.word_bounds(buf, offs, kernel.SPACED)
    n_bytes, n_words = np.maximum(np.diff(offs), 1).astype(float), np.diff(at).astype(float)
    per_word = np.maximum(n_words, 1)
    out = np.zeros((len(offs) - 1, len(FEATURES)))
    col = dict(zip(FEATURES, out.T))
    col["log_words"][:] = np.log1p(n_words)
    col["word_length"][:] = _sums(kernel.SPACED[buf], offs) / per_word
    for name in _TABLES:
        col[name][:] = _sums(_TABLES[name][buf], offs) / n_bytes
    grams, gat = kernel.shingle_hashes(words, at, 3)
    for t in range(len(out)):
        a, b = at[t], at[t + 1]
        if b > a:
            col["word_repeat"][t] = 1 - len(np.unique(words[a:b])) / (b - a)
            col["gram_repeat"][t] = 1 - len(np.unique(grams[gat[t]:gat[t + 1]])) / (gat[t + 1] - gat[t])
    lines = _sums(_TABLES["newline"][buf], offs) + 1
    col["line_length"][:] = np.log1p(n_words / lines)
    if len(ends):
        marked = np.concatenate([[0], np.cumsum(_SYMBOL[buf[ends - 1]])])
        col["odd_words"][:] = (marked[at[1:]] - marked[at[:-1]]) / per_word
    return out


@dataclass
class Model:
    """Bin edges, lookup tables by feature and by pair, and the intercept."""

    edges: list[np.ndarray]
    tables: np.ndarray
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[b[:, j]]
        for (i, j), grid in zip(self.pairs, self.grids):
            total += grid[b[:, i] * COARSE // BINS, b[:, j] * COARSE // BINS]
        return 1 / (1 + np.exp(-total))


def _tree(gradient: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """Leaf value of every bin: the bins are cut ``depth`` times where the gain
    is highest; a leaf's value is a Newton step."""
    out = np.zeros(len(gradient))

    def value(g: float, h: float) -> float:
        return g / (h + 1.0)

    def split(lo: int, hi: int, depth: int) -> None:
        g, h = gradient[lo:hi].sum(), weight[lo:hi].sum()
        if depth and hi - lo > 1:
            gl, hl = np.cumsum(gradient[lo:hi - 1]), np.cumsum(weight[lo:hi - 1])
            gain = gl ** 2 / (hl + 1.0) + (g - gl) ** 2 / (h - hl + 1.0) - g ** 2 / (h + 1.0)
            best = int(np.argmax(gain))
            if gain[best] > 1e-9:
                split(lo, lo + best + 1, depth - 1)
                split(lo + best + 1, hi, depth - 1)
                return
        out[lo:hi] = value(g, h)

    split(0, len(gradient), depth)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting on a bounded sample; without both labels the model is its
    intercept."""
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, j], quantiles)) if len(x) else np.zeros(0)
             for j in range(len(FEATURES))]
    model = Model(edges, np.zeros((len(FEATURES), BINS)))
    rate = (y.sum() + 1.0) / (len(y) + 2.0)
    model.base = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return model
    b = model.binned(x)
    total = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j in range(len(FEATURES)):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _tree(np.bincount(b[:, j], y - p, BINS), np.bincount(b[:, j], p * (1 - p), BINS), 2)
            model.tables[j] += step
            total += step[b[:, j]]
    p = 1 / (1 + np.exp(-total))
    cells = {}
    for i in range(len(FEATURES)):
        for j in range(i + 1, len(FEATURES)):
            cell = (b[:, i] * COARSE // BINS) * COARSE + b[:, j] * COARSE // BINS
            g, h = np.bincount(cell, y - p, COARSE ** 2), np.bincount(cell, p * (1 - p), COARSE ** 2)
            cells[float((g ** 2 / (h + 1.0)).sum()), -i, -j] = cell
    for (_, i, j), cell in sorted(cells.items(), reverse=True)[:PAIRS]:
        model.pairs.append((-i, -j))
        model.grids.append(np.zeros((COARSE, COARSE)))
    chosen = [(-i, -j, cell) for (_, i, j), cell in sorted(cells.items(), reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for k, (_, _, cell) in enumerate(chosen):
            p = 1 / (1 + np.exp(-total))
            g = np.bincount(cell, y - p, COARSE ** 2).reshape(COARSE, COARSE)
            h = np.bincount(cell, p * (1 - p), COARSE ** 2).reshape(COARSE, COARSE)
            # a tree of two levels: cut the first feature, then the second in each half
            rows = _tree(g.sum(axis=1), h.sum(axis=1), 1)
            step = np.zeros((COARSE, COARSE))
            for r in np.unique(rows):
                half = rows == r
                step[half] = _tree(g[half].sum(axis=0), h[half].sum(axis=0), 1)
            step *= RATE
            model.grids[k] += step
            total += step.ravel()[cell]
    return model


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in kernel.text_blocks(batch.column(1)):
            x = features(buf, offs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]),
                                          pa.array(x.ravel()))], names=["doc_id", "x"])


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("long").cast("string")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents that are not held out.

    Labels other than 0 and 1, null ids and labels without a document are left
    out; repeated labels count as often as they stand.  No usable label gives a
    model that scores every text alike.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")) \
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = F.broadcast(usable.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .join(chosen.select("doc_id").distinct(), "doc_id", "left_semi") \
        .mapInArrow(_feature_rows, "doc_id long, x array<double>") \
        .join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(sample).collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows], float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.  Null and empty texts
    are scored as texts without words; repeated rows get equal scores; labels
    and all other columns are never read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in kernel.text_blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(model.score(features(buf, offs)))],
                    names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(run, "doc_id long, score double") \
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, all columns kept."""
    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        parts = [model.score(features(buf, offs)) for _, _, buf, offs in kernel.text_blocks(text)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.filter(score(F.col("text")) >= LIMIT)
