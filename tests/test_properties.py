"""Property tests: the Spark column expressions and the DuckDB rules agree
on random tag strings (two independent implementations of each check)."""

import random

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators.formatting import CHECKS, format_checks
from skein.plans import sqlparts as S

PIECES = ["<think>", "</think>", "<answer>", "</answer>", "<Think>", "</THINK>", "<ANSWER>",
          "</Answer>", " ", "  ", "\n", "yes", "no", "Yes", "maybe", "word", "ACDE", "é",
          "日本", "x_y", "42", "<thin", "k>", "|", "\t"]


def random_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_checks_match_duckdb(spark):
    import duckdb
    texts = random_texts(1500, 7)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, completion string")
    got = {r["i"]: r for r in format_checks(df, keep=["i"]).collect()}
    con = duckdb.connect()
    con.execute("create table c(i int, completion varchar)")
    con.executemany("insert into c values (?, ?)", list(enumerate(texts)))
    checks = S.checks("completion")
    sql = "select i, " + ", ".join(f"{v} as {k}" for k, v in checks.items()) + " from c"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    bad = []
    for row in cur.fetchall():
        d = dict(zip(names, row))
        s = got[d["i"]]
        for k in CHECKS:
            a, b = s[k], d[k]
            if isinstance(a, float) or isinstance(b, float):
                same = abs(float(a) - float(b)) < 1e-9
            else:
                same = a == b
            if not same:
                bad.append((k, texts[d["i"]], a, b))
    assert not bad, bad[:5]


def test_answers_match_duckdb(spark):
    import duckdb
    texts = random_texts(1500, 11)
    kws = ["word|yes", "", "|", "ACDE|é|ACDE", "zzz"]
    rows = [(i, t, kws[i % len(kws)]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, c string, k string")
    got = {r[0]: (r[1], r[2], r[3]) for r in df.select(
        "i", T.binary_answer(F.col("c")), T.keyword_mention(F.col("c"), "k"),
        T.answer_confidence(F.col("c"), F.lit("no|yes"), F.lit("0.250|0.750"))).collect()}
    con = duckdb.connect()
    con.execute("create table c(i int, c varchar, k varchar)")
    con.executemany("insert into c values (?, ?, ?)", rows)
    sql = ("select i, " + S.binary_answer("c") + ", " + S.mention("c", "k") + ", "
           + S.answer_reward("c", "'no|yes'", "'0.250|0.750'") + " from c")
    for i, a, m, r in con.execute(sql).fetchall():
        ga, gm, gr = got[i]
        assert ga == a, (texts[i], ga, a)
        assert abs(gm - m) < 1e-12 and abs(gr - r) < 1e-12, texts[i]
