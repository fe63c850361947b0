"""The eleven format checks, the composite format reward (A10) and the
per-group failure report (A14).

One scan, two projections: the inner one extracts what several checks
share (think blocks, the stripped text); the outer one derives the checks.
Catalyst keeps the shared extracts evaluated once per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T

# Composite terms, in the reference's order; the last is dropped when use_go.
CHECKS = ("has_think", "tagged_ratio", "not_too_long", "one_answer", "answer_after_thinks",
          "thinks_have_text", "no_nested_tags", "limited_thinks", "tags_closed",
          "ends_with_answer", "starts_with_think")


def _checks(t: Column, think: Column, stripped: Column, tags: Column) -> dict[str, Column]:
    # The tag counts come from the one tag extraction F1 needs anyway.
    n_think = T.tag_count(tags, T.THINK_OPEN_CI)
    n_answer = T.tag_count(tags, T.ANSWER_OPEN_CI)
    has_think = (n_think > 0).cast("int")
    has_tag = ((n_think + n_answer) > 0).cast("int")
    think_ok = (F.length(T.strip(F.array_join(think, " "))) > T.MIN_THINK_CHARS).cast("int")
    return {
        "has_think": has_think,
        "tagged_ratio": T.tagged_ratio(t),
        "not_too_long": T.not_too_long(t),
        "one_answer": (n_answer == 1).cast("int"),
        "answer_after_thinks": T.answer_after_thinks(t),
        "thinks_have_text": think_ok * has_think,
        "no_nested_tags": T.no_nested_tags(t) * has_tag,
        "limited_thinks": (n_think <= T.MAX_THINKS).cast("int") * has_think,
        "tags_closed": T.tags_closed_from(tags) * has_tag,
        "ends_with_answer": stripped.endswith("</answer>").cast("int"),
        "starts_with_think": stripped.startswith("<think>").cast("int"),
    }


def format_checks(df: DataFrame, text_col: str = "completion", keep: Sequence[str] = (),
                  use_go: bool = False, blocks: bool = False) -> DataFrame:
    """Per row: the eleven composite terms and ``format_reward``.

    ``use_go`` drops the last term (starts-with-think) and divides by 10.
    ``blocks`` adds the extracted blocks as ``_think`` and ``_answers``, for
    scores that need them as well.
    """
    t = F.col(text_col)
    inner = df.select(*keep, t.alias("_t"), T.think_blocks(t).alias("_think"),
                      T.strip(t).alias("_stripped"), T.all_tags(t).alias("_tags"),
                      *[T.answer_blocks(t).alias("_answers")] * blocks)
    checks = _checks(F.col("_t"), F.col("_think"), F.col("_stripped"), F.col("_tags"))
    names = list(CHECKS[:-1] if use_go else CHECKS)
    composite = sum((checks[n] for n in names[1:]), checks[names[0]]) / len(names)
    return inner.select(*keep, *[checks[n].alias(n) for n in names],
                        composite.alias("format_reward"), *["_think", "_answers"] * blocks)


def format_report(checked: DataFrame, by: Sequence[str]) -> DataFrame:
    """Failure rate of each term (1 - mean) and mean composite per group.

    A grouped aggregation with map-side partial aggregation, so a hot group
    is combined before the shuffle.
    """
    terms = [c for c in CHECKS if c in checked.columns]
    aggs = [F.count(F.lit(1)).alias("n"),
            F.avg("format_reward").alias("mean_format_reward")]
    aggs += [(1 - F.avg(c)).alias(f"fail_{c}") for c in terms]
    return checked.groupBy(*by).agg(*aggs)


def format_rollup(checked: DataFrame, by: Sequence[str]) -> DataFrame:
    """A14 at every level of ``by``: per group, per prefix of ``by``, and over all.

    ``level`` is how many of the columns are summed away (0: none); ``grouping_id``
    tells a null that is a total from one that is a value.  The rows are read once:
    each map task sums all levels before the shuffle.
    """
    terms = [c for c in CHECKS if c in checked.columns]
    gid = F.grouping_id()
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("format_reward").alias("mean_format_reward"),
            *[(1 - F.avg(c)).alias(f"fail_{c}") for c in terms], gid.alias("grouping_id"),
            F.bit_count(gid).cast("int").alias("level")]
    return checked.rollup(*by).agg(*aggs)
