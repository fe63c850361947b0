"""Vector expressions on ``array<float|double>`` columns.

All of these are higher-order functions evaluated in the JVM; model weights
enter as literal arrays whose size is the model's, not the data's.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from skein.functions.text import RESIDUES


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _equal_lengths(a: Column, b: Column, out: Column) -> Column:
    """``out``; vectors of unequal lengths fail the job."""
    return F.when(F.size(a) != F.size(b), F.raise_error(F.concat(
        F.lit("vectors of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"),
        F.lit(" elements")))).otherwise(out)


def vsub(a, b) -> Column:
    """N6 element-wise a - b (float32 when both inputs are float32)."""
    a, b = _c(a), _c(b)
    return _equal_lengths(a, b, F.zip_with(a, b, lambda x, y: x - y))


def vadd(a, b) -> Column:
    a, b = _c(a), _c(b)
    return _equal_lengths(a, b, F.zip_with(a, b, lambda x, y: x + y))


def vconcat(a, b) -> Column:
    return F.concat(_c(a), _c(b))


def vround(v, digits: int = 6) -> Column:
    return F.transform(_c(v), lambda x: F.round(x.cast("double"), digits))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y),
                       F.lit(0.0), lambda acc, v: acc + v)


def _lit_matrix(rows: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(w)) for w in r]) for r in rows])


def _lit_vector(vals: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(w)) for w in vals])


def mlp_logit(x, w1: Sequence[Sequence[float]], b1: Sequence[float],
              w2: Sequence[float], b2: float) -> Column:
    """N7 two-layer scorer: W2·relu(W1 x + b1) + b2 (logit).

    ``w1`` is hidden×input, ``w2`` has one weight per hidden unit.
    """
    xv = _c(x)
    hidden = F.transform(
        F.arrays_zip(_lit_matrix(w1).alias("w"), _lit_vector(b1).alias("b")),
        lambda r: F.greatest(dot(r["w"], xv) + r["b"], F.lit(0.0)))
    return dot(_lit_vector(w2), hidden) + F.lit(float(b2))


def composition(seq, alphabet: str = RESIDUES) -> Column:
    """Default embedder: one-hot residues mean-pooled → residue shares.

    Empty or null sequences give null (there is nothing to average).
    """
    s = _c(seq)
    n = F.length(s)
    shares = F.transform(
        F.array(*[F.lit(a) for a in alphabet]),
        lambda a: ((n - F.length(F.replace(s, a, F.lit("")))) / n).cast("float"))
    return F.when(n > 0, shares)


def _motifs(s: Column, w: int) -> Column:
    n = F.length(s)
    starts = F.when(n >= w, F.sequence(F.lit(1), n - w + 1)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(s, i, w))


def _repeat_excess(sorted_motifs: Column) -> Column:
    """Σ(c - 1) over runs of equal motifs longer than two, on a sorted array."""
    def extra(run):
        return F.when(run > 2, run - 1).otherwise(F.lit(0)).cast("long")

    init = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("run"),
                    F.lit(0).cast("long").alias("total"))
    return F.aggregate(
        sorted_motifs, init,
        lambda st, m: F.when(m == st["prev"], F.struct(
            st["prev"].alias("prev"), (st["run"] + 1).alias("run"), st["total"].alias("total")))
        .otherwise(F.struct(m.alias("prev"), F.lit(1).alias("run"),
                            (st["total"] + extra(st["run"])).alias("total"))),
        lambda st: st["total"] + extra(st["run"]))


def motif_repeats(seq, widths=(2, 3, 4)) -> Column:
    """A3: Σ over widths of Σ(c-1) for sliding motifs seen more than twice.

    Row-local and O(L log L): the motifs of each width are sorted and equal
    runs counted in one pass — no explode, no shuffle.  (For long texts
    use ``operators.designs.motif_repeats_long``.)
    """
    s = _c(seq)
    total = F.lit(0).cast("long")
    for w in widths:
        total = total + _repeat_excess(F.array_sort(_motifs(s, w)))
    return F.when(s.isNotNull(), total)



def residue_dominance(seq) -> Column:
    """A4: -(count of the most frequent character / length); empty → null."""
    s = _c(seq)
    n = F.length(s)
    chars = F.array_distinct(F.split(s, ""))
    top = F.array_max(F.transform(chars, lambda c: n - F.length(F.replace(s, c, F.lit("")))))
    return F.when(n > 0, -(top / n))


def _repeats_of(text: str, widths) -> int:
    """Σ(c-1) over motifs with c > 2 for one text (numpy, code points)."""
    cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    total = 0
    for w in widths:
        n = len(cp) - w + 1
        if n <= 0:
            continue
        bits = 64 // w
        if w * 21 > 64 and n and int(cp.max()) >= (1 << bits):
            counts = np.array(list(Counter(text[i:i + w] for i in range(n)).values()))
        else:
            code = np.zeros(n, dtype=np.uint64)
            for j in range(w):
                code = (code << np.uint64(bits)) | cp[j:j + n]
            counts = np.unique(code, return_counts=True)[1]
        total += int((counts[counts > 2] - 1).sum())
    return total


@F.pandas_udf(LongType())
def motif_repeats_text(texts: pd.Series) -> pd.Series:
    """A3 for long texts over Arrow batches: motifs of widths 2–4 packed into
    integer codes and counted with ``np.unique`` (row-local, no shuffle)."""
    return pd.Series([None if t is None else _repeats_of(t, (2, 3, 4)) for t in texts],
                     dtype="Int64")
