"""Answer-mode scoring — binary answer, keyword mention, answer reward
(F14, F17, F19), the asymmetric reshaping (N1) and the total (N2).

All native expressions on the completion row; the prompt columns arrive on
the same row (JN10: completions carry their prompt's classes, confidences
and keywords, joined on the prompt key upstream).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import numeric as N
from skein.functions import text as T
from skein.operators.formatting import format_checks


def score_answers(df: DataFrame, keep: Sequence[str] = (), text_col: str = "completion",
                  use_go: bool = False) -> DataFrame:
    """Per completion: format, mention, answer, scaled answer and total."""
    cols = list(dict.fromkeys([*keep, "keywords", "classes", "class_confidences"]))
    t = F.col(text_col)
    # blocks, think text and answer are columns, so that each is made once a row
    fmt = format_checks(df, text_col, keep=dict.fromkeys([*cols, text_col]), use_go=use_go, blocks=True) \
        .select(*dict.fromkeys([*cols, text_col]), "format_reward",
                F.array_join("_think", " ").alias("_think"),
                T.binary_answer(t, F.col("_answers")).alias("_answer"))
    answer = T.answer_confidence(t, "classes", "class_confidences", F.col("_answer"))
    scored = fmt.select(
        *keep, "format_reward",
        T.keyword_mention(t, "keywords", think=F.col("_think")).alias("mention_reward"),
        answer.alias("answer_reward"))
    scaled = N.asymmetric_reward("answer_reward")
    return scored.select(
        *keep, "format_reward", "mention_reward", "answer_reward",
        scaled.alias("scaled_answer_reward"),
        N.answer_total("format_reward", scaled, "mention_reward").alias("total_reward"))


def binary_answers(df: DataFrame, keep: Sequence[str] = (),
                   text_col: str = "completion") -> DataFrame:
    return df.select(*keep, T.binary_answer(F.col(text_col)).alias("answer"))


def attach_prompts(completions: DataFrame, prompts: DataFrame, key: str,
                   check_unique: bool = True) -> DataFrame:
    """JN10: give each completion its prompt's columns (many completions per
    prompt).  An equi-join on the prompt key — the reference zips parallel
    lists positionally; here the key makes the pairing explicit.  A duplicate
    prompt key would fan rows out, so it is checked first."""
    if check_unique:
        from skein.operators.guards import require_unique
        require_unique(prompts, [key])
    return completions.join(prompts, key, "inner")
