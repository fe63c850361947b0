"""Rule tests: hand-derived expectations for the text checks (F1–F19),
covering the quirks listed in the survey (adjacent tags, mixed case, empty
answer, glued words, "unknown" counting as no)."""

import pytest
from pyspark.sql import functions as F

from skein.functions import numeric as N
from skein.functions import text as T
from skein.operators.formatting import format_checks


def ev(spark, expr, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_tags_closed(spark):
    cases = {
        "<think>a</think><answer>b</answer>": 1,
        "no tags at all": 1,
        "<Think>a</think>": 0,          # names compared as written
        "<THINK>a</THINK>": 1,
        "<think><answer>x</think></answer>": 0,
        "<think>a": 0,
        "</think>": 0,
        "<think><answer>x</answer></think>": 1,
    }
    assert ev(spark, T.tags_closed, list(cases)) == list(cases.values())


def test_start_end_and_strip(spark):
    texts = ["  <think>x</think> <answer>y</answer>\n\t", "<THINK>x</THINK><answer>y</ANSWER>"]
    assert ev(spark, T.starts_with_think, texts) == [1, 0]
    assert ev(spark, T.ends_with_answer, texts) == [1, 0]
    assert ev(spark, T.strip, ["  a b  "]) == ["a b"]


def test_answer_after_thinks_adjacent_fails(spark):
    texts = ["<think>a</think><answer>b</answer>",      # adjacent → 0
             "<think>a</think> <answer>b</answer>",     # one char between → 1
             "<answer>b</answer><think>a</think>",
             "<think>a</think>",
             "<think>a</think> x </THINK> <ANSWER>b</answer>"]
    assert ev(spark, T.answer_after_thinks, texts) == [0, 1, 0, 0, 1]


def test_counts(spark):
    t = ["<think>a</think> <think>b</think> <think>c</think> <think>d</think>",
         "<Answer>x</answer><answer>y</answer>", "<answer>z</answer>"]
    assert ev(spark, T.limited_thinks, t) == [0, 1, 1]
    assert ev(spark, T.one_answer, t) == [0, 0, 1]
    assert ev(spark, T.has_think, ["<THINK>", "think", None]) == [1, 0, None]
    assert ev(spark, T.has_any_tag, ["<Answer>", "</answer>"]) == [1, 0]


def test_word_count_unicode_and_limit(spark):
    assert ev(spark, T.word_count, ["héllo wörld_1, x-y 42", "日本語 テキスト", ""]) == [5, 2, 0]
    long_text = " ".join(["w"] * 200)
    assert ev(spark, T.not_too_long, [long_text, long_text + " z"]) == [1, 0]


def test_tagged_ratio_glue_and_case(spark):
    # Tags are deleted case-sensitively before counting, so words glue;
    # the tag names inside blocks are not counted as tagged words.
    texts = ["<think>a b</think> c", "x<think>y</think>z", "<Think>a</think> b", "", "<think></think>"]
    got = ev(spark, T.tagged_ratio, texts)
    assert got[0] == pytest.approx(2 / 3)
    assert got[1] == pytest.approx(1.0)      # "xyz" is one word; "y" is tagged
    assert got[2] == pytest.approx(0.0)      # mixed-case block never matches
    assert got[3] == 0.0 and got[4] == 0.0


def test_nested_and_think_text(spark):
    texts = ["<think>a <answer>b</answer></think>", "<think>plain words here</think>",
             "<THINK>x <think> y</think>"]
    assert ev(spark, T.no_nested_tags, texts) == [0, 1, 0]
    assert ev(spark, T.think_text, ["<think>a</think> and <THINK>b\nc</think>"]) == ["a b\nc"]
    assert ev(spark, T.thinks_have_text, ["<think>  0123456789 </think>",
                                          "<think>0123456789a</think>"]) == [0, 1]


def test_binary_answer(spark):
    texts = ["<answer>Yes, likely</answer>", "<answer>unknown</answer>", "<answer>maybe</answer> yes",
             "<answer>maybe</answer> yes no", "no tags, yes", "maybe", "<ANSWER> NO </ANSWER>", "nothing"]
    assert ev(spark, T.binary_answer, texts) == [True, False, True, None, None, None, False, False]


def test_designed_sequence(spark):
    texts = ["<answer> ACDE </answer>", "<answer>acde</answer>", "no block", "<answer></answer>"]
    got = ev(spark, T.designed_sequence, texts)
    assert [tuple(r) for r in got] == [("ACDE", True), (None, False), (None, None), ("", True)]


def test_keyword_mention(spark):
    df = spark.createDataFrame([
        ("<think>alpha beta</think>", "alpha|gamma"),
        ("<think>alpha beta</think>", "|"),
        ("no think", "alpha"),
        ("<think>alpha alpha</think>", "alpha|alpha|zeta"),
        ("<think>alpha</think>", "alpha|beta|gamma"),
    ], "c string, k string")
    answer_mode = [r[0] for r in df.select(T.keyword_mention(F.col("c"), "k")).collect()]
    design_mode = [r[0] for r in df.select(
        T.keyword_mention(F.col("c"), "k", design_mode=True)).collect()]
    assert answer_mode == [0.5, 1.0, 0.0, pytest.approx(2 / 3), pytest.approx(1 / 3)]
    assert design_mode == [1.0, 1.0, 0.0, pytest.approx(2 / 3), 1.0]


def test_answer_confidence(spark):
    df = spark.createDataFrame([
        ("<answer>yes</answer>", "no|yes", "0.300|0.700"),
        ("<answer>no</answer>", " YES | No ", "0.250|0.750"),
        ("<answer>yes</answer>", "maybe|no|yes", "0.1|0.9"),     # past the zip → 0
        ("maybe", "no|yes", "0.5|0.5"),
    ], "c string, cl string, cf string")
    got = [r[0] for r in df.select(T.answer_confidence(F.col("c"), "cl", "cf")).collect()]
    assert got == [0.7, 0.75, 0.0, 0.0]


def test_asymmetric_and_plddt(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (1.0,)], "x double")
    got = [r[0] for r in df.select(N.asymmetric_reward("x")).collect()]
    assert got == pytest.approx([0.0, 0.5 * 0.5 ** 1.3, 0.5, 1.0])
    d = spark.createDataFrame([(60.0, 50.0), (40.0, 50.0)], "a double, b double")
    import math
    got = [r[0] for r in d.select(N.plddt_reward("a", "b")).collect()]
    assert got == pytest.approx([0.1 + 0.5 * math.tanh(0.4), 0.5 * math.tanh(-0.4)])


def test_composite_use_go(spark):
    df = spark.createDataFrame([("<think>enough thinking here</think> <answer>yes</answer>",)],
                               "completion string")
    full = format_checks(df).head()["format_reward"]
    go = format_checks(df, use_go=True).head()["format_reward"]
    assert full == pytest.approx(1.0) and go == pytest.approx(1.0)
    df2 = spark.createDataFrame([("plain text without tags",)], "completion string")
    r = format_checks(df2).head()
    # only not_too_long holds; ratio is 0 (no tagged words)
    assert r["format_reward"] == pytest.approx(1 / 11)
