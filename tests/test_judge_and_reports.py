"""The judge plug-in, exact decimals, levels, sketches, hash trees and file order."""

import json
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from skein.functions.numeric import fixed3
from skein.operators import fingerprint as FP
from skein.operators import formatting
from skein.operators import judge as JU
from skein.operators import prompts as PM
from skein.operators import report as RP
from skein.operators import votes as VO

# -- the judge -----------------------------------------------------------------


def requests(spark, pairs):
    rows = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "design_seq string, ref_seq string, id int")
    return rows.withColumn("question", VO.judge_question("design_seq", "ref_seq", "T"))


def counting_judge(folder):
    """A judge that leaves a file for each sample it was asked for."""
    def build():
        def respond(question, samples):
            for s in samples:
                with open(os.path.join(folder, f"{abs(hash(question))}-{s}-{random.random()}"), "w") as f:
                    json.dump([question, s], f)
            return [f"<answer>yes {s}</answer>" for s in samples]
        return respond
    return build


def asked(folder):
    out = []
    for name in os.listdir(folder):
        with open(os.path.join(folder, name)) as f:
            out.append(tuple(json.load(f)))
    return sorted(out)


def test_second_run_asks_only_for_what_is_missing(spark, tmpdir_path):
    logs = [os.path.join(tmpdir_path, f"asked{i}") for i in range(3)]
    for folder in logs:
        os.makedirs(folder)
    path = os.path.join(tmpdir_path, "responses")
    first = requests(spark, [("A", "B"), ("A", "B"), ("C", None), (None, "B")])
    got = JU.judge_into(first, path, counting_judge(logs[0]), samples=2)
    question = "Target T: would you pick candidate {} over candidate {}? Reply yes or no.".format
    assert asked(logs[0]) == [(question("A", "B"), s) for s in range(2)]       # once, and nulls never
    assert got.count() == 2
    more = requests(spark, [("A", "B"), ("D", "B")])
    got = JU.judge_into(more, path, counting_judge(logs[1]), samples=3)
    assert asked(logs[1]) == [(question("A", "B"), 2)] + [(question("D", "B"), s) for s in range(3)]
    assert sorted((r.design_seq, r.sample) for r in got.collect()) == [(d, s) for d in "AD" for s in range(3)]
    got = JU.judge_into(more, path, counting_judge(logs[2]), samples=3)
    assert asked(logs[2]) == [] and got.count() == 6
    assert spark.read.parquet(path).count() == 6
    shares = {r.design_seq: (r.n_responses, r.yes_fraction) for r in VO.vote_shares(got).collect()}
    assert shares == {"A": (3, 1.0), "D": (3, 1.0)}


def test_judge_runs_laterally_and_checks_its_judge(spark, tmpdir_path):
    missing = JU.missing_samples(requests(spark, [("A", "B")]), None)
    plan = JU.ask(missing)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" in plan and "CartesianProduct" not in plan
    with pytest.raises(Exception, match="1 responses to 3 samples"):
        JU.ask(missing, lambda: lambda question, samples: ["yes"]).collect()
    assert JU.judge_into(requests(spark, [("A", "B")]).limit(0), os.path.join(tmpdir_path, "none")).count() == 0


# -- three decimals --------------------------------------------------------------

def test_fixed3_equals_python(spark):
    rnd = random.Random(7)
    values = [k / 16 for k in range(0, 4000)] + [k / 2000 for k in range(0, 4001)] + [1 - k / 2000 for k in range(2001)]
    values += [rnd.random() for _ in range(500_000)] + [rnd.uniform(0, 1e-3) for _ in range(100_000)]
    values += [(2 * rnd.randrange(1000) + 1) / 2000 for _ in range(100_000)]
    near = [struct.unpack("<d", struct.pack("<q", struct.unpack("<q", struct.pack("<d", v))[0] + d))[0]
            for v in [(2 * k + 1) / 2000 for k in range(1000)] for d in range(-3, 4)]
    values += near + [rnd.uniform(-1e9, 1e9) for _ in range(100_000)] + [k + 0.0625 for k in range(100_000)]
    values += [0.0, -0.0, -0.0001, -0.0005, 5e-324, 1e-300, 0.9995, 0.99949999, 2.0 ** 42 + 0.0625, 9.9e15, 1e18, 999.9995, 999.9996]
    df = spark.createDataFrame(((v,) for v in values), "x double").select("x", fixed3("x").alias("t"))
    bad = [(r.x, r.t) for r in df.collect() if r.t != f"{r.x:.3f}"]
    assert len(values) > 900_000 and not bad
    odd = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(fixed3("x").alias("t"))
    assert [r.t for r in odd.collect()] == [None, None]


# -- levels ----------------------------------------------------------------------

def test_rollup_tells_null_values_from_totals(spark):
    df = spark.createDataFrame([(None, 1, "x"), ("a", 1, "<think>x</think>"), ("a", None, "y")],
                               "task string, step int, completion string")
    checked = formatting.format_checks(df, keep=["task", "step"])
    got = {(r.task, r.step, r.grouping_id, r.level, r.n) for r in
           formatting.format_rollup(checked, ["task", "step"]).collect()}
    assert got == {(None, 1, 0, 0, 1), ("a", 1, 0, 0, 1), ("a", None, 0, 0, 1),
                   (None, None, 1, 1, 1), ("a", None, 1, 1, 2), (None, None, 3, 2, 3)}


# -- sketches --------------------------------------------------------------------

def test_merged_sketches_keep_the_rank_bound(spark):
    rnd = random.Random(3)
    rows = [(i % 40, rnd.choice([rnd.gauss(0, 1), round(rnd.random(), 1)])) for i in range(60_000)]
    df = spark.createDataFrame(rows, "step int, total_reward double")
    merged = RP.merged_report(RP.reward_sketches(df), quantiles=(0.01, 0.1, 0.5, 0.9, 0.99)).head()
    direct = RP.merged_report(RP.reward_sketches(df, by=()), quantiles=(0.01, 0.1, 0.5, 0.9, 0.99)).head()
    values = sorted(v for _, v in rows)
    for got in (merged, direct):
        assert got["n"] == len(rows) and got["min_total_reward"] == values[0]
        assert got["mean_total_reward"] == pytest.approx(sum(values) / len(values))
        for q in (1, 10, 50, 90, 99):
            x = got[f"q{q}_total_reward"]
            low = sum(v < x for v in values) / len(values)
            high = sum(v <= x for v in values) / len(values)
            assert low - 0.02 <= q / 100 <= high + 0.02


def test_sketches_of_small_and_null_groups(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 2.0), (2, None)], "step int, total_reward double")
    sketches = RP.reward_sketches(df)
    got = {r.half: (r.n, r.q50_total_reward, r.mean_total_reward) for r in RP.merged_report(
        sketches.withColumn("half", F.floor(F.col("step") / 2)), by=["half"]).collect()}
    assert got == {0: (3, 2.0, 2.0), 1: (1, None, None)}
    assert RP.merged_report(sketches.limit(0), by=["step"]).count() == 0


# -- hash trees ------------------------------------------------------------------

def vectors(spark, table):
    return spark.createDataFrame([(k, v) for k, v in table], "seq string, embedding array<float>")


def differences(spark, old, new, digits=4):
    a, b = vectors(spark, old), vectors(spark, new)
    trees = [FP.hash_tree(t, digits=digits) for t in (a, b)]
    return {(r.key, r.change) for r in FP.table_diff(a, b, *trees, digits=digits).collect()}


def test_diff_names_exactly_what_differs(spark):
    rnd = random.Random(1)
    old = {f"s{i}": [rnd.random(), rnd.random()] for i in range(3000)}
    new = dict(old)
    for k in ("s1", "s2999"):
        del new[k]
    new["t1"] = [0.0]
    new["s7"] = [old["s7"][0], old["s7"][1] + 0.5]
    new["s8"] = old["s8"][:1]
    want = {("s1", "removed"), ("s2999", "removed"), ("t1", "added"), ("s7", "changed"), ("s8", "changed")}
    for digits in (2, 4, 5):
        assert differences(spark, old.items(), new.items(), digits) == want
    shuffled = list(old.items())
    rnd.shuffle(shuffled)
    assert differences(spark, old.items(), shuffled) == set()


def test_diff_of_repeated_keys_nulls_and_empty_tables(spark):
    rows = [("a", [1.0]), ("a", [1.0]), (None, [2.0]), ("n", None), ("m", [None]), ("i", [float("inf")])]
    assert differences(spark, rows, rows) == set()
    assert differences(spark, rows, rows[1:]) == {("a", "changed")}
    assert differences(spark, rows, []) == {(k, "removed") for k in ("a", "\\N", "n", "m", "i")}
    assert differences(spark, rows[3:4], [("n", [])]) == {("n", "changed")}
    assert differences(spark, [], []) == set()


def test_tree_levels_and_depth(spark):
    table = vectors(spark, [(f"s{i}", [float(i)]) for i in range(500)])
    tree = FP.hash_tree(table, digits=2)
    by_level = {r.level: (r["count"], r.n) for r in tree.groupBy("level").agg(F.count("*").alias("count"), F.sum("n").alias("n")).collect()}
    assert by_level[0] == (1, 500) and by_level[1] == (16, 500) and by_level[2][1] == 500
    assert [FP.tree_digits(n) for n in (0, 1024 << 8, (1024 << 8) + 1, 1 << 60)] == [2, 2, 3, 8]


# -- order of files --------------------------------------------------------------

def test_rows_of_files_in_order(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "parts")
    rows = spark.range(1000).select(F.col("id"), F.lit("s").alias("system_prompt"), F.lit("u").alias("user_prompt"))
    rows.repartitionByRange(7, "id").sortWithinPartitions("id").write.option("maxRecordsPerFile", 90).parquet(path)
    got = PM.ordered_cycle(PM.read_in_order(spark, path)).collect()
    assert sorted((r.position, r.replica, r.row, r.id) for r in got) == [
        (1000 * k + i, k, i, i) for k in range(2) for i in range(1000)]
    once = PM.ordered_cycle(PM.read_in_order(spark, path), balance=False)
    assert once.count() == 1000 and "Window" not in once._jdf.queryExecution().executedPlan().toString()
    copy = PM.scoring_copy(rows.limit(1)).head()
    assert copy.scoring_prompt == copy.prompt.replace("s\n", "s" + PM.REASONING_SUFFIX + "\n", 1)
