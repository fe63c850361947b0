"""Numeric reward shapes (N1–N5, N8) and the reward totals, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the scoring rules) --------------------------
# Asymmetric reward: threshold 0.5 on [0, 1], exponents 1.3 below, 0.7 above.
ASYM_THRESHOLD = 0.5
ASYM_ALPHA = 1.3
ASYM_BETA = 0.7
# pLDDT reward slope.
PLDDT_ALPHA = 0.04
# Answer-mode total: format, scaled answer, mention weights.
ANSWER_WEIGHTS = (0.5, 2.5, 0.5)
# Design-mode total: format, design, diversity, mention, repetition weights.
DESIGN_WEIGHTS = (0.5, 2.5, 0.25, 0.5, 0.25)
# Completions per prompt in design training; the ledger penalty divides by it.
NUM_GENERATIONS = 4
# Diversity squash divisor.
DIVERSITY_SCALE = 10.0
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def asymmetric_reward(x, xmin: float = 0.0, xmax: float = 1.0,
                      threshold: float = ASYM_THRESHOLD, alpha: float = ASYM_ALPHA,
                      beta: float = ASYM_BETA) -> Column:
    """Below the threshold 0.5*norm^alpha, above 0.5 + 0.5*norm^beta."""
    v = _c(x)
    low = 0.5 * F.pow((v - xmin) / (threshold - xmin), F.lit(alpha))
    high = 0.5 + 0.5 * F.pow((v - threshold) / (xmax - threshold), F.lit(beta))
    return F.when(v < threshold, low).otherwise(high)


def plddt_reward(design_plddt, ref_plddt, alpha: float = PLDDT_ALPHA) -> Column:
    """d<0 → 0.5*tanh(alpha d); else d/100 + 0.5*tanh(alpha d)."""
    d = _c(design_plddt).cast("double") - _c(ref_plddt).cast("double")
    base = 0.5 * F.tanh(alpha * d)
    return F.when(d < 0, base).otherwise(d / 100 + base)


def diversity_squash(repeats) -> Column:
    """1 - tanh(r / 10)."""
    return 1 - F.tanh(_c(repeats) / DIVERSITY_SCALE)


def sigmoid(x) -> Column:
    """N8."""
    return 1 / (1 + F.exp(-_c(x)))


def answer_total(fmt, scaled_answer, mention, weights=ANSWER_WEIGHTS) -> Column:
    """0.5*format + 2.5*N1(answer) + 0.5*mention."""
    wf, wa, wm = weights
    return wf * _c(fmt) + wa * _c(scaled_answer) + wm * _c(mention)


def repetition_penalty(prior_count, generations: int = NUM_GENERATIONS) -> Column:
    """W1 penalty: f = floor(c / G); f / (f + G)."""
    f = F.floor(_c(prior_count) / generations)
    return f.cast("double") / (f + generations)


def design_total(fmt, design, diversity, mention, repetition,
                 weights=DESIGN_WEIGHTS) -> Column:
    """0.5*format + 2.5*design + 0.25*diversity + 0.5*mention - 0.25*rep."""
    wf, wd, wv, wm, wr = weights
    return (wf * _c(fmt) + wd * _c(design) + wv * _c(diversity)
            + wm * _c(mention) - wr * _c(repetition))


#: Splits a double into halves of 26 bits (2**27 + 1).
_SPLITTER = 134217729.0


def fixed3(x) -> Column:
    """A double with three decimals, as Python's ``"%.3f"`` renders it.

    Python rounds the exact binary value, half to even; ``format_string`` and
    ``round`` round its decimal text.  Here the fraction is split into two halves
    whose products with 1000 are exact.  The higher product is rounded; what is
    left of it, less or plus one half, with the lower product added, has the sign
    of the exact sum, which tells whether the next integer is nearer or there is a
    tie.  Holds for magnitudes below 2**63; null and NaN give null.
    """
    v = _c(x).cast("double")
    size = F.abs(v)
    units = F.floor(size)
    part = size - units                                  # exact
    big = part * _SPLITTER
    high = big - (big - part)
    a, b = high * 1000.0, (part - high) * 1000.0         # both exact
    whole = F.floor(a + 0.5)
    rest = a - whole                                     # exact, -0.5 to 0.5
    above, below = (rest - 0.5) + b, (rest + 0.5) + b    # signs are exact
    odd = F.pmod(whole, F.lit(2)) == 1
    n = F.when((above > 0) | ((above == 0) & odd), whole + 1) \
        .when((below < 0) | ((below == 0) & odd), whole - 1).otherwise(whole)
    sign = F.when((v < 0) | (v.cast("string") == "-0.0"), "-").otherwise("")
    text = F.concat(sign, (units + F.floor(n / 1000)).cast("string"), F.lit("."),
                    F.lpad(F.pmod(n, F.lit(1000)).cast("string"), 3, "0"))
    return F.when(v.isNotNull() & ~F.isnan(v), text)
