"""J11 with a judge in it: N sampled responses per question (UDF plug point 3).

A judge is a factory of ``respond(question, samples) -> texts``: one text for each
sample number.  It runs inside a Python table function that is joined laterally
to the requests, one request to its missing samples, and is built once for each
task (a model is loaded there, or a client of one is opened).  Responses are
kept in a table keyed by (design_seq, ref_seq, sample); a run asks only for the
samples that the table lacks, by a keyed anti-join, so an interrupted or
extended run never pays for a response twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.streaming.files import is_folder

SAMPLES = 3     # responses per request
KEYS = ("design_seq", "ref_seq", "sample")
RESPONSE_SCHEMA = "design_seq string, ref_seq string, sample int, answers string"

Respond = Callable[[str, Sequence[int]], Sequence[str]]


def rule_judge() -> Respond:
    """The judge that needs no model: the first hexadecimal digit of
    ``md5(question:sample)`` answers yes (0-7), no (8-e), or forgets the tags (f)."""
    def respond(question: str, samples: Sequence[int]) -> list[str]:
        out = []
        for s in samples:
            digit = hashlib.md5(f"{question}:{s}".encode()).hexdigest()[0]
            out.append("yes, I would" if digit == "f" else
                       f"<think>sample {s}</think> <answer> {'Yes' if digit < '8' else 'no'} </answer>")
        return out
    return respond


def judge_function(judge: Callable[[], Respond]):
    """A table function (question, samples) -> (sample, answers) around a judge.

    Inputs and outputs travel as Arrow batches.  A judge that returns another
    number of texts than it was asked for fails the job.
    """
    class Judge:
        def __init__(self):
            self.respond = judge()

        def eval(self, question: str, samples):
            samples = [int(s) for s in samples]
            texts = list(self.respond(question, samples))
            if len(texts) != len(samples):
                raise ValueError(f"{len(texts)} responses to {len(samples)} samples")
            yield from zip(samples, texts)

    return F.udtf(Judge, returnType="sample int, answers string", useArrow=True)


def _equal(a: DataFrame, b: DataFrame) -> Column:
    cond = F.lit(True)
    for k in KEYS:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def missing_samples(requests: DataFrame, stored: DataFrame | None, samples: int = SAMPLES) -> DataFrame:
    """One row per (design_seq, ref_seq, question) with the sample numbers, in
    order, that ``stored`` lacks; requests that lack none are left out.

    Equal requests are one, however many completions made them; a request
    without a question (a null design or reference) is never asked.  Samples are
    compared by key before they are gathered, so no response text is read.
    """
    wanted = requests.filter(F.col("question").isNotNull()).select("design_seq", "ref_seq", "question").distinct() \
        .withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    if stored is not None:
        have = stored.select(*KEYS)
        wanted = wanted.join(have, _equal(wanted, have), "left_anti")
    return wanted.groupBy("design_seq", "ref_seq", "question").agg(
        F.sort_array(F.collect_list("sample")).alias("samples"))      # at most ``samples`` numbers


def ask(missing: DataFrame, judge: Callable[[], Respond] = rule_judge) -> DataFrame:
    """Responses (``RESPONSE_SCHEMA``) to every missing sample."""
    respond = judge_function(judge)
    return missing.lateralJoin(respond(F.col("question").outer(), F.col("samples").outer())) \
        .select(*KEYS, "answers")


def judge_into(requests: DataFrame, path: str, judge: Callable[[], Respond] = rule_judge,
               samples: int = SAMPLES) -> DataFrame:
    """Ask for what the table at ``path`` lacks, append it (S8), and return the
    stored responses to ``requests``: all their samples below ``samples``.

    The append is one committed write: tasks that are run again leave no second
    copy, and a run that fails leaves none.  Two runs must not write to one table
    at the same time.
    """
    spark = requests.sparkSession
    stored = spark.read.schema(RESPONSE_SCHEMA).parquet(path) if is_folder(spark, path) else None
    ask(missing_samples(requests, stored, samples), judge).write.mode("append").parquet(path)
    table = spark.read.schema(RESPONSE_SCHEMA).parquet(path).filter(F.col("sample") < samples)
    asked = requests.filter(F.col("question").isNotNull()).select("design_seq", "ref_seq").distinct()
    cond = table["design_seq"].eqNullSafe(asked["design_seq"]) & table["ref_seq"].eqNullSafe(asked["ref_seq"])
    return table.join(asked, cond, "left_semi")
