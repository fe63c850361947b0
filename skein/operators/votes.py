"""Judge questions and vote shares.

Generating the judge's responses is model serving and is not part of this
toolkit; the job starts from response rows ``(design_seq, ref_seq,
answers)``.  The vote parse follows the judge path of the reference: the
first ``<answer>`` block matched case-sensitively, stripped and lower-cased;
a response without a block counts as "not yes".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T

# Question template: {target}, {design} and {reference} are filled per row.
DEFAULT_QUESTION = ("Target {target}: would you pick candidate {design} "
                    "over candidate {reference}? Reply yes or no.")


def judge_question(design, reference, target: str, template: str = DEFAULT_QUESTION) -> Column:
    """The question text for one (design, reference) pair."""
    d = F.col(design) if isinstance(design, str) else design
    r = F.col(reference) if isinstance(reference, str) else reference
    pieces = template.replace("{target}", target).split("{design}")
    if len(pieces) != 2 or "{reference}" not in pieces[1]:
        raise ValueError("template needs one {design} followed by one {reference}")
    mid, tail = pieces[1].split("{reference}")
    return F.concat(F.lit(pieces[0]), d, F.lit(mid), r, F.lit(tail))


def judge_requests(completions: DataFrame, target: str, keep=(), text_col="completion",
                   keywords="keywords", template: str = DEFAULT_QUESTION) -> DataFrame:
    """One question per completion that designed a valid sequence."""
    ds = T.designed_sequence(F.col(text_col))
    rows = completions.select(*keep, ds["seq"].alias("design_seq"),
                              T.first_keyword(keywords).alias("ref_seq"))
    rows = rows.filter(F.col("design_seq").isNotNull())
    return rows.withColumn("question", judge_question("design_seq", "ref_seq", target, template))


def vote_is_yes(answers) -> Column:
    a = F.col(answers) if isinstance(answers, str) else answers
    first = F.get(F.regexp_extract_all(a, F.lit(T.ANSWER_BLOCK_CS), 1), 0)
    return F.coalesce(F.contains(F.lower(T.strip(first)), F.lit("yes")), F.lit(False))


def vote_shares(responses: DataFrame, design="design_seq", ref="ref_seq",
                answers="answers") -> DataFrame:
    """A2: yes-share per (design, reference); partial aggregation map-side."""
    yes = vote_is_yes(answers).cast("int")
    return responses.groupBy(design, ref).agg(
        F.count(F.lit(1)).alias("n_responses"),
        F.sum(yes).alias("n_yes"),
        F.avg(yes).alias("yes_fraction"))


def append_responses(responses: DataFrame, path: str) -> None:
    """Append a batch of judge responses (one row per response)."""
    responses.select("design_seq", "ref_seq", "answers").write.mode("append").parquet(path)
