"""Operator tests against brute force on small fixtures."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import vectors as V
from skein.operators import ledger as LG
from skein.operators import designs as DS
from skein.operators import embed as EM
from skein.operators import fingerprint as FP
from skein.operators import metrics as ME
from skein.operators import pairs as PR
from skein.operators.guards import DuplicateKeyError
from tests.conftest import SF_SMALL


def brute_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    credit = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return credit / (len(pos) * len(neg))


@pytest.mark.parametrize("ranges", [1, 3, 256])
def test_exact_auc_with_ties(spark, ranges):
    rnd = random.Random(ranges)
    rows = [(float(rnd.randint(0, 30)) / 10, rnd.randint(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "score double, label int")
    assert ME.exact_auc(df, ranges=ranges) == pytest.approx(brute_auc(rows))


def test_binary_metrics_row(spark):
    rows = [(0.9, 1), (0.8, 0), (0.3, 1), (0.1, 0), (0.5, 1)]
    m = ME.binary_metrics(spark.createDataFrame(rows, "score double, label int")).head()
    assert m["n"] == 5 and m["n_pos"] == 3
    assert m["accuracy"] == pytest.approx(2 / 5)    # 0.5 is not above 0.5
    assert m["hard_auc"] == pytest.approx((1 / 3 + 1 / 2) / 2)
    assert m["auc"] == pytest.approx(brute_auc(rows))


def test_dense_index_is_a_permutation(spark):
    keys = [f"s{i}" for i in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "seq string").repartition(7)
    idx, n = PR.dense_index(df, "seq")
    got = sorted(r["idx"] for r in idx.collect())
    assert n == 3000 and got == list(range(3000))


def test_partners_independent_of_partitioning(spark):
    rows = [(f"S{i}", float(i % 17)) for i in range(400)]
    df = spark.createDataFrame(rows, "generate_seq string, plddt double")
    a = sorted(tuple(r) for r in PR.sample_partners(df.repartition(1)).collect())
    b = sorted(tuple(r) for r in PR.sample_partners(df.repartition(9)).collect())
    assert a == b and len(a) == 5 * 400
    assert {r[3] for r in a} <= {k for k, _ in rows}


def test_duplicate_scores_fail_with_keys(spark):
    df = spark.createDataFrame([("AAA", 1.0), ("AAA", 2.0), ("CCC", 1.0)],
                               "generate_seq string, plddt double")
    with pytest.raises(DuplicateKeyError, match="AAA"):
        PR.cycle_pairs(df, resolve="error")
    assert PR.cycle_pairs(df, resolve="max").count() == 10


def brute_repeats(g):
    total = 0
    for w in (2, 3, 4):
        counts = {}
        for i in range(len(g) - w + 1):
            counts[g[i:i + w]] = counts.get(g[i:i + w], 0) + 1
        total += sum(c - 1 for c in counts.values() if c > 2)
    return total


def test_motif_paths_agree(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ACDA é") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    expect = {i: brute_repeats(t) for i, t in enumerate(texts)}
    hof = {r[0]: r[1] for r in df.select("i", V.motif_repeats("t")).collect()}
    udf = {r[0]: r[1] for r in df.select("i", V.motif_repeats_text("t")).collect()}
    local = {r[0]: r[1] for r in DS.motif_repeats_long(df, ["i"], "t").collect()}
    assert hof == expect and udf == expect and local == expect


def test_motif_repeats_of_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1, "ABABAB"), (1, "ABABAB"), (None, "ABABAB"), (2, None)], "i int, t string")
    got = sorted(((r[0], r[1]) for r in DS.motif_repeats_long(df, ["i"], "t").collect()), key=repr)
    n = brute_repeats("ABABAB")
    assert got == sorted([(1, n), (1, n), (None, n), (2, None)], key=repr) and n > 0
    long = spark.createDataFrame([(1, "ACDE" * 300_000)], "i int, t string")
    assert DS.motif_repeats_long(long, "i", "t").head()["repeats"] > 3_000_000


def test_prior_counts_beyond_one_range_of_steps(spark):
    rows = [(s * 700, p, k) for s in range(40) for p, k in enumerate(["a", None, "a", "b"])]
    df = spark.createDataFrame(rows, "step long, pos long, generate_seq string")
    seen, want = {}, []
    for s, p, k in sorted(rows, key=lambda r: r[:2]):
        want.append((s, p, seen.get(k, 0)))
        seen[k] = seen.get(k, 0) + 1
    out = LG.prior_counts(df)
    assert sorted((r.step, r.pos, r.prior_count) for r in out.collect()) == want
    import re
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line:           # never the key alone
            part = re.findall(r"\], \[([^\]]*)\], \[", line)[0]
            assert part.count("#") >= 2, line


def test_mean_pool_drops_first_and_last(spark):
    rows = [("a", 1, [1.0, 10.0]), ("a", 2, [2.0, 20.0]), ("a", 3, [4.0, 40.0]),
            ("a", 4, [100.0, 0.0]), ("b", 1, [1.0, 1.0]), ("b", 2, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "seq_key string, position int, embedding array<double>")
    got = {r[0]: r[1] for r in EM.mean_pool(df).collect()}
    assert got["a"] == pytest.approx([3.0, 30.0]) and got["b"] is None


def test_incremental_embedding_and_pandas_embedder(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "emb")
    first = spark.createDataFrame([("ACD",), ("ACD",), ("WWY",)], "seq string")
    EM.append_embeddings(EM.embed_sequences(first), path)
    cache = spark.read.parquet(path)
    more = spark.createDataFrame([("ACD",), ("KLM",), ("",), (None,)], "seq string")
    new = EM.embed_sequences(more, cache=cache)
    assert [r["seq"] for r in new.collect()] == ["KLM"]

    def comp(seqs):
        letters = "ARNDCEQGHILKMFPSTWYV"
        return [[s.count(a) / len(s) for a in letters] for s in seqs]

    pandas_vecs = {r[0]: r[1] for r in EM.PandasEmbedder(comp).apply(first.distinct()).collect()}
    column_vecs = {r[0]: r[1] for r in EM.embed_sequences(first).collect()}
    for k in column_vecs:
        assert pandas_vecs[k] == pytest.approx(column_vecs[k], abs=1e-7)


def test_fingerprint_is_order_free_and_sensitive(spark):
    rows = [(f"k{i}", [float(i) / 7, -float(i)]) for i in range(50)]
    a = spark.createDataFrame(rows, "seq string, embedding array<double>")
    b = spark.createDataFrame(list(reversed(rows)), "seq string, embedding array<double>")
    fa = FP.table_fingerprint(a).head()["fingerprint"]
    assert fa == FP.table_fingerprint(b.repartition(5)).head()["fingerprint"]
    changed = rows[:-1] + [("k49", [49 / 7, -49.0 + 1e-5])]
    c = spark.createDataFrame(changed, "seq string, embedding array<double>")
    assert FP.verify_fingerprint(a, fa) is True
    with pytest.warns(UserWarning):
        assert FP.verify_fingerprint(c, fa) is False


def test_group_advantage_skewed_group(spark):
    from skein.operators.report import group_advantage
    rows = [(0, i, float(i % 5)) for i in range(3000)] + [(1, 0, 2.0)] + \
           [(g, i, float(i)) for g in range(2, 50) for i in range(3)]
    df = spark.createDataFrame(rows, "g int, pos int, total_reward double")
    out = group_advantage(df, ["g"]).filter("g < 2").groupBy("g").agg(
        F.avg("advantage").alias("a"), F.max("group_size").alias("n")).orderBy("g").collect()
    assert out[0]["n"] == 3000 and abs(out[0]["a"]) < 1e-9
    assert out[1]["n"] == 1 and out[1]["a"] == 0.0


def test_batch_scorer_matches_column_scorer(spark):
    from pyspark.ml.functions import array_to_vector  # noqa: F401
    from skein.operators.scoring import PairScorer
    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, x array<double>")
    sc = PairScorer.by_rule(8, hidden=4)
    col = {r[0]: r[1] for r in df.select("i", sc.probability_expr(F.col("x"))).collect()}
    udf = sc.batch_udf(batch_size=64)
    bat = {r[0]: r[1] for r in df.select("i", udf("x")).collect()}
    assert all(abs(col[k] - bat[k]) < 1e-12 for k in col)
    again = PairScorer.from_table(sc.to_table(spark))
    assert again == PairScorer(*[list(map(list, sc.w1)), list(sc.b1), list(sc.w2), sc.b2])


def test_attach_prompts_checks_keys(spark):
    from skein.operators.answers import attach_prompts
    comp = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "pid int, completion string")
    prompts = spark.createDataFrame([(1, "no|yes"), (2, "no|yes")], "pid int, classes string")
    assert attach_prompts(comp, prompts, "pid").count() == 3
    dup = prompts.unionByName(prompts)
    with pytest.raises(DuplicateKeyError):
        attach_prompts(comp, dup, "pid")


def test_model_save_load_and_examples(spark, tmpdir_path):
    from skein.operators import classifier as CL
    from skein.operators import prompts as PM
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, features array<double>").withColumn(
        "label", (F.col("features")[0] > 0).cast("int"))
    model, metrics = CL.train_and_evaluate(df, "k", 4, max_iter=20)
    assert {r["split"] for r in metrics.collect()} == {"train", "validation"}
    path = os.path.join(tmpdir_path, "model")
    CL.save_model(model, path)
    assert CL.load_model(path).numFeatures == 4
    ex = PM.design_examples(fx_design_prompts(spark))
    PM.write_examples(ex, os.path.join(tmpdir_path, "ex"), fmt="json")
    assert spark.read.json(os.path.join(tmpdir_path, "ex")).count() == ex.count()


def fx_design_prompts(spark):
    from skein.sources import fixtures
    return fixtures.design_prompts(spark, SF_SMALL)
