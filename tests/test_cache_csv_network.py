"""The bucketed cache, CSV read in splits, the trained network, and small guards."""

import csv
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import vectors as V
from skein.operators import cache, guards, network
from skein.operators.scoring import PairScorer, score_pairs
from skein.sources import fixtures as fx
from skein.sources.csv import read_multiline_csv, records


# -- the cache -------------------------------------------------------------------

def side_without_exchange(plan: str, table: str) -> bool:
    """Whether the scan of ``table`` reaches its join through no exchange."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-|"))
    for line in reversed(lines[:at]):
        d = len(line) - len(line.lstrip(" :+-|"))
        if d < depth:
            depth = d
            if "Exchange" in line:
                return False
            if "Join" in line:
                return True
    return False


def test_cache_side_has_no_exchange(spark, tmpdir_path):
    table = cache.append_to_cache(spark.createDataFrame([(f"s{i}", [float(i)]) for i in range(500)], cache.SCHEMA),
                                  "cache_plan", os.path.join(tmpdir_path, "c"), buckets=8)
    asked = spark.createDataFrame([(f"s{i % 700}",) for i in range(3000)] + [(None,), ("",)], "seq string")
    for out in (cache.uncached(asked, table), cache.cached_vectors(asked, table)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert side_without_exchange(plan, "cache_plan"), plan
        assert "SelectedBucketsCount: 8 out of 8" in plan
    assert cache.uncached(asked, table).count() == 200
    assert cache.cached_vectors(asked, table).count() == 500


def test_cache_computes_each_sequence_once(spark, tmpdir_path):
    path, calls = os.path.join(tmpdir_path, "c"), []

    class Counting:
        def apply(self, seqs, key):
            calls.append(sorted(r[0] for r in seqs.collect()))
            return seqs.select(key, F.array(F.length(key).cast("float")).alias("embedding"))

    def seqs(*names):
        return spark.createDataFrame([(n,) for n in names], "seq string")

    cache.embed_into(seqs("A", "A", None, ""), "cache_once", path, embedder=Counting(), buckets=4)
    cache.embed_into(seqs("A", "BB"), "cache_once", path, embedder=Counting(), buckets=4)
    spark.sql("drop table cache_once")                   # another session opens it by its path
    out = cache.embed_into(seqs("BB", "A", "CCC"), "cache_again", path, embedder=Counting(), buckets=4)
    assert calls == [["A"], ["BB"], ["CCC"]]
    assert {(r.seq, r.embedding[0]) for r in out.collect()} == {("A", 1.0), ("BB", 2.0), ("CCC", 3.0)}


# -- CSV ---------------------------------------------------------------------------

FIELDS = ["", "plain", "two\nlines", 'say ""hi""'.replace('""', '"'), "a,b", "\n", '"', "x\r\ny", "é\n\"q\"\n", " sp "]


@pytest.mark.parametrize("split", [16, 64, 1 << 20])
def test_records_cut_at_every_border_equal_the_plain_reader(spark, tmpdir_path, split):
    rnd = random.Random(split)
    paths, want = [], []
    for i, header in enumerate((["a", "b"], ["a", "b"], ["b", "c", "a"])):
        paths.append(os.path.join(tmpdir_path, f"f{i}.csv"))
        rows = [[rnd.choice(FIELDS) for _ in header] for _ in range(60)]
        with open(paths[-1], "w", newline="") as f:
            out = csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator="\r\n" if i == 1 else "\n")
            out.writerow(header)
            out.writerows(rows)
    for name in paths:
        plain = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(name)
        want += [tuple(sorted(r.asDict().items())) for r in plain.collect()]

    def shown(rows):                                     # the plain reader folds breaks inside fields
        return sorted(repr(r).replace("\\r\\n", "\\n") for r in rows)

    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        parts = read_multiline_csv(spark, paths)
        got = [tuple(sorted(r.asDict().items())) for p in parts for r in p.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [p.columns for p in parts] == [["a", "b"], ["b", "c", "a"]]
    assert shown(got) == shown(want) and any("x\r\ny" in dict(r).values() for r in got)


def test_csv_of_odd_files(spark, tmpdir_path):
    texts = {"empty": "", "head": "a,b\n", "blank": "a,b\n\n1,2\n\n", "open": 'a,b\n1,"x\ny"'}
    for name, text in texts.items():
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(text)
    paths = [os.path.join(tmpdir_path, n) for n in texts]
    [frame] = read_multiline_csv(spark, paths)
    assert sorted(map(tuple, frame.collect())) == [("1", "2"), ("1", "x\ny")]
    assert records(spark, paths[:1]).count() == 0
    with open(paths[0], "w") as f:
        f.write("a,b\n1,2,3\n")
    with pytest.raises(Exception):
        [p.collect() for p in read_multiline_csv(spark, paths[:1])]


# -- the network ---------------------------------------------------------------------

def test_training_equals_a_numpy_run(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    rows = [(i, x[i].tolist(), int(y[i])) for i in range(300)] + [(900, None, 1), (901, x[0].tolist(), None)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int")
    part = {r.id: r.b for r in df.select("id", network.batch_number("id", 4).alias("b")).collect()}
    number = np.array([part[i] for i in range(300)])
    w, losses = network.first_weights(6, 8, 7), []
    adam, seen = network.Adam(len(w)), []
    for i, b in enumerate(network.batch_order(3, 4, 7), 1):
        g = network.gradient(w, x[number == b], y[number == b])
        w = adam.step(w, g[:-2] / g[-1])
        seen.append(g[-2:])
        if i % 4 == 0:
            losses.append(sum(s[0] for s in seen) / sum(s[1] for s in seen))
            seen = []
    want = network._layers(w, 6)
    for tasks in (1, 5):
        scorer, got = network.fit(df.repartition(tasks), "id", 6, hidden=8, epochs=3, seed=7)
        for a, b in zip((scorer.w1, scorer.b1, scorer.w2, scorer.b2), want):
            assert np.allclose(a, b, atol=1e-9)
        assert got == pytest.approx(losses) and got[-1] < got[0]
    stored = PairScorer.from_table(scorer.to_table(spark))
    assert np.allclose(stored.w1, scorer.w1) and stored.b2 == scorer.b2
    probe = df.filter("id < 5").withColumn("has_vectors", F.lit(True))
    p = [r.probability for r in score_pairs(probe, stored).orderBy("id").collect()]
    w1, b1, w2, b2 = want
    assert np.allclose(p, 1 / (1 + np.exp(-(np.maximum(x[:5] @ w1.T + b1, 0) @ w2 + b2))))


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(9, 3)), rng.integers(0, 2, 9)
    w = network.first_weights(3, 4, 5)
    g = network.gradient(w, x, y)
    for i in range(len(w)):
        e = np.zeros(len(w))
        e[i] = 1e-6
        slope = (network.gradient(w + e, x, y)[-2] - network.gradient(w - e, x, y)[-2]) / 2e-6
        assert g[i] == pytest.approx(slope, abs=1e-5)


def test_training_without_rows(spark):
    df = spark.createDataFrame([], "id long, features array<double>, label int")
    scorer, losses = network.fit(df, "id", 3, hidden=2, epochs=1)
    assert losses == [] and len(scorer.w1) == 2


# -- guards ----------------------------------------------------------------------------

def test_vectors_of_unequal_lengths_fail(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<double>, b array<double>")
    for f in (V.vsub, V.vadd):
        with pytest.raises(Exception, match="vectors of 2 and 1 elements"):
            df.select(f("a", "b")).collect()
    null = spark.createDataFrame([(None, [1.0])], "a array<double>, b array<double>")
    assert null.select(V.vsub("a", "b").alias("x")).head().x is None


def test_broadcast_price_follows_the_element_type(spark):
    rows = [(f"s{i}", [0.0] * 100) for i in range(50)]
    budget = 50 * (48 + 16 + 4 * 100)
    wide = spark.createDataFrame(rows, "seq string, embedding array<double>")
    narrow = spark.createDataFrame(rows, "seq string, embedding array<float>")
    assert guards.vectors_fit_broadcast(narrow, "embedding", budget=budget)
    assert not guards.vectors_fit_broadcast(wide, "embedding", budget=budget)


def test_gaps_in_ids_are_an_error(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "embeddings.parquet")
    spark.createDataFrame([(i, [1.0], 1) for i in (0, 1, 3)], "vec_id long, embedding array<float>, label int") \
        .write.parquet(path)
    with pytest.raises(ValueError, match="0 to n - 1"):
        fx.pairs(spark, tmpdir_path)
