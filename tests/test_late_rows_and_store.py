"""Streams that keep late rows, and the keyed log."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from skein.session import scratch_path
from skein.streaming import files, lateness
from skein.streaming import rewards as STR
from skein.streaming.sinks import RowsLost, run_available
from skein.streaming.store import KeyedLog, latest, totals
from tests.conftest import SF_SMALL

EVENTS = "user string, value double, ts timestamp"


def arrive(spark, folder, batches, schema=EVENTS):
    """One file for each list of (user, value, minute), to be read one a batch."""
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame([(u, v, m) for u, v, m in rows], "user string, value double, m int")
        frame.select("user", "value", F.timestamp_seconds(F.col("m") * 60).alias("ts")).coalesce(1) \
            .write.mode("overwrite").parquet(os.path.join(folder, f"p{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(folder, "*"))


def minutes(rows, *times):
    return sorted((r["user"], *(int(r[t].timestamp() // 60) for t in times), r["n"], r["total"]) for r in rows)


BATCHES = [[("a", 1.0, 100), ("b", 1.0, 100)], [("a", 2.0, 300), ("a", 4.0, 100), ("b", None, 295)],
           [("a", 8.0, 99), ("b", 3.0, None), ("b", 5.0, 700)], [("a", 16.0, 120), ("b", 7.0, 699), (None, 1.0, 701)]]


def test_rows_are_judged_by_earlier_batches(spark, tmpdir_path):
    stream = arrive(spark, os.path.join(tmpdir_path, "in"), BATCHES)
    taken = lateness.take_in(stream, "ts", "30 minutes", os.path.join(tmpdir_path, "out"))
    late = sorted(r.value for r in taken.late.collect())
    assert late == [3.0, 8.0, 16.0]                      # without a time, and behind the mark
    assert taken.ontime.count() == 8
    again = lateness.take_in(stream, "ts", "30 minutes", taken.base)
    assert again.ontime.count() == 8 and again.late.count() == 3


def test_windows_lose_nothing_and_state_is_bounded(spark, tmpdir_path):
    rnd = random.Random(4)
    batches = [[(rnd.choice("ab"), float(rnd.randrange(9)), 60 * hour + rnd.randrange(60) - rnd.choice([0, 0, 0, 900]))
                for _ in range(30)] for hour in range(20, 60, 4)]
    progress = []
    taken = lateness.take_in(arrive(spark, os.path.join(tmpdir_path, "in"), batches), "ts", "1 hour",
                             os.path.join(tmpdir_path, "out"))
    assert taken.late.count() > 10
    got = lateness.windowed_report(taken, ["user"], "value", "1 hour", progress)
    want = {}
    for u, v, m in (r for b in batches for r in b):
        n, total = want.get((u, m // 60), (0, 0.0))
        want[u, m // 60] = n + 1, total + v
    rows = {(r.user, int(r.w.start.timestamp() // 3600)): (r.n, r.total) for r in got.collect()}
    assert rows == want
    assert all(r.mean == pytest.approx(r.total / r.n) for r in got.collect())
    kept = [op["numRowsTotal"] for p in progress for op in p["stateOperators"]]
    assert kept and kept[-1] < len(want) / 2             # closed windows have left the state
    assert sum(op["numRowsRemoved"] for p in progress for op in p["stateOperators"]) >= 10
    assert all(op["numRowsDroppedByWatermark"] == 0 for p in progress for op in p["stateOperators"])


def plain_sessions(rows, gap):
    out = []
    for user in {u for u, _, _ in rows}:
        own = sorted((m, v) for u, v, m in rows if u == user and m is not None)
        for m, v in own:
            if out and out[-1][0] == user and m <= out[-1][2]:
                out[-1] = (user, out[-1][1], m + gap, out[-1][3] + 1, out[-1][4] + v)
            else:
                out.append((user, m, m + gap, 1, v))
    return sorted(out)


def test_sessions_are_those_of_all_rows(spark, tmpdir_path):
    """Late rows bridge closed sessions, and a gap of exactly the length still joins."""
    batches = [[("a", 1.0, 100), ("b", 1.0, 100), ("a", 1.0, 130)], [("a", 1.0, 161), ("b", 2.0, 400)],
               [("a", 1.0, 900), ("b", 1.0, 131)], [("a", 4.0, 145), ("a", 1.0, 930), ("b", 9.0, 130)],
               [("a", 1.0, 2000), ("c", 5.0, 50), ("c", 5.0, None)]]
    progress = []
    taken = lateness.take_in(arrive(spark, os.path.join(tmpdir_path, "in"), batches), "ts", "10 minutes",
                             os.path.join(tmpdir_path, "out"))
    got = lateness.session_report(taken, "user", "value", "30 minutes", progress)
    assert minutes(got.collect(), "session_start", "session_end") == plain_sessions([r for b in batches for r in b], 30)
    assert sum(op["numRowsRemoved"] for p in progress for op in p["stateOperators"]) > 0


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (2, 1, 0)])
def test_join_is_the_batch_join_in_any_order(spark, tmpdir_path, order):
    prompts = [[("k%d" % (10 * b + i), 0.0, 100 * b + i) for i in range(5)] for b in range(3)]
    answers = [[("k%d" % (10 * b + i), 1.0 * j, 100 * b + i + 10 * j) for i in range(6) for j in range(3)] for b in range(3)]
    progress, base = [], os.path.join(tmpdir_path, "out")
    taken = [lateness.take_in(arrive(spark, os.path.join(tmpdir_path, name), [rows[i] for i in arrival]), "ts",
                              "20 minutes", os.path.join(base, name))
             for name, rows, arrival in (("p", prompts, order), ("c", answers, order[::-1]))]
    p = taken[0]
    shown = lateness.Taken(p.spark, p.base, p.schema, p.time, p.delay)
    named = StructType([StructField("user", StringType()), StructField("value", p.schema["value"].dataType),
                        StructField("ts", p.schema["ts"].dataType)])
    assert shown.schema.names == named.names
    # the prompt side under other names
    for kind in ("ontime", "late"):
        if files.is_folder(spark, f"{p.base}/{kind}"):
            for b in files.names(spark, f"{p.base}/{kind}"):
                spark.read.parquet(f"{p.base}/{kind}/{b}").select("user", F.col("ts").alias("shown")) \
                    .write.mode("overwrite").parquet(f"{base}/q/{kind}/{b}")
    schema = StructType([StructField("user", StringType()), StructField("shown", p.schema["ts"].dataType)])
    q = lateness.Taken(spark, f"{base}/q", schema, "shown", p.delay)
    got = lateness.joined_prompts(taken[1], q, "user", "15 minutes", f"{base}/joined", progress)
    want = sorted((k, v) for part in answers for k, v, m in part
                  for pk, _, pm in (r for b in prompts for r in b) if k == pk and pm <= m <= pm + 15)
    assert sorted((r.user, r.value) for r in got.collect()) == want
    assert all(op["numRowsDroppedByWatermark"] == 0 for x in progress for op in x["stateOperators"])


def test_a_dropped_row_is_an_error(spark, tmpdir_path):
    stream = arrive(spark, os.path.join(tmpdir_path, "in"), BATCHES).withWatermark("ts", "30 minutes")
    with pytest.raises(RowsLost):
        run_available(stream.groupBy(F.window("ts", "1 hour")).count(), "lossy")


def test_queries_agree_with_batch(spark):
    progress = []
    out = STR.stream_prompts_joined(spark, SF_SMALL, progress)
    assert out.count() > 0 and progress
    assert STR.stream_sessions(spark, SF_SMALL).count() > 0


# -- the keyed log ---------------------------------------------------------------

SCHEMA = StructType([StructField("k", StringType()), StructField("total", LongType())])


def log_of(spark, fan=3, merge=None, schema=SCHEMA):
    return KeyedLog(spark, scratch_path(spark, "log"), schema, ["k"], merge or totals(["k"], "total"), fan, 4)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_log_sums_merges_and_deletes(spark):
    log, want = log_of(spark), {}
    rnd = random.Random(2)
    assert log.last_version() == -1 and log.read().count() == 0
    for version in range(11):
        rows = [(rnd.choice([None, *"abcdefg"]), rnd.randrange(5)) for _ in range(6)]
        for k, n in rows:
            want[k] = want.get(k, 0) + n
        log.append(frame(spark, rows), version)
        assert {r.k: r.total for r in log.read().collect()} == want
    assert log.last_version() == 10
    assert len(log.runs(10)) <= 2 * 3 + 1
    held = {n for v in (9, 10) for _, n in log.runs(v)}
    assert set(files.names(spark, f"{log.path}/runs")) == {f"run={n}" for n in held}
    some = frame(spark, [("a", 0), (None, 0)])
    assert {r.k: r.total for r in log.read(keys_of=some).collect()}.items() >= {("a", want["a"]), (None, want[None])}


def test_a_batch_that_runs_again_counts_once(spark):
    log = log_of(spark, fan=2)
    for version in (0, 1, 2, 2, 2, 3):
        log.append(frame(spark, [("a", 1)]), version)
    assert [(r.k, r.total) for r in log.read().collect()] == [("a", 4)]


def test_what_a_batch_writes_follows_the_batch(spark):
    """A growing table and batches of one size: rows written stay near the batch
    times the levels, far below the table once a batch."""
    log, written = log_of(spark, fan=4), []
    write = log._write

    def counted(rows, run):
        written.append(rows.count())
        write(rows, run)

    log._write = counted
    n, batches = 200, 16
    for version in range(batches):
        log.append(frame(spark, [(f"{version}-{i}", 1) for i in range(n)]), version)
    assert log.read().count() == n * batches
    levels = 1 + 2                                       # 16 batches, merged by fours
    assert sum(written) <= n * batches * levels
    assert sum(written) < n * sum(range(1, batches + 1)) / 2


def test_latest_row_stands(spark):
    schema = StructType([StructField("k", StringType()), StructField("v", StringType()), StructField("_batch", LongType())])
    log = log_of(spark, fan=2, merge=latest(["k"], ["v"], "_batch"), schema=schema)
    for version, rows in enumerate([[("a", "1"), ("b", "1")], [("a", None)], [("b", "3"), (None, "x")]]):
        log.append(spark.createDataFrame([(k, v, version) for k, v in rows], schema), version)
    assert {(r.k, r.v) for r in log.read().collect()} == {("a", None), ("b", "3"), (None, "x")}
