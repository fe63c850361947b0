"""Reward scoring, the ledger and windowed summaries over arriving data.

The reference calls its reward function once per trainer step with that
step's completions and keeps the ledger in process memory.  Here completions
arrive as a stream: scoring is a stateless projection (same columns as the
batch job), the ledger is a keyed streaming aggregation (state in the
state store, checkpointed), and the running count is a keyed stateful
operator.  ``step`` is a data column, not engine state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType, TimestampNTZType

from skein.operators import answers, designs, ledger
from skein.sources import fixtures as fx
from skein.session import scratch_path
from skein.sources.tables import table_path
from skein.streaming import lateness
from skein.streaming.sinks import finish, read_stream, read_written, run_available
from skein.streaming.store import KeyedLog, totals


def stream_answer_scores(spark: SparkSession, sf_dir: str, source: DataFrame | None = None,
                         base: str | None = None) -> DataFrame:
    """ST1: completions (from arriving conversations) scored as in J08.
    ``base`` names the output and checkpoint folder of a run to continue."""
    conv = read_stream(spark, sf_dir, "conversations") if source is None else source
    scored = answers.score_answers(fx.completions_from(conv), keep=["conv_id", "turn", "step"])
    return run_available(scored, "stream_rewards", base=base)


def _design_stream(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    gen = read_stream(spark, sf_dir, "embeddings") if source is None else source
    comp = fx.design_completions(spark, sf_dir, generated=gen)
    return designs.score_designs(comp, keep=["id"], inline_vectors=True)


def stream_ledger(spark: SparkSession, sf_dir: str, source: DataFrame | None = None,
                  base: str | None = None) -> DataFrame:
    """ST2: last design reward and count per sequence, updated per batch.
    ``base`` names the output and checkpoint folder of a run to continue."""
    agg = ledger.last_scores(_design_stream(spark, sf_dir, source))
    return run_available(agg, "stream_ledger", mode="update", keys=["generate_seq"], base=base)


def in_parts(spark: SparkSession, sf_dir: str, table: str, column: str, parts: int,
             newest_first: bool = False) -> Iterator[DataFrame]:
    """Let a table arrive in several parts: writes the next range of ``column`` to a
    folder of its own and yields the stream over all of them.  Cut points are
    approximate, so no task holds the column; a part keeps its natural partitions."""
    yield from arriving(spark, spark.read.parquet(table_path(sf_dir, table)), table, column, parts, newest_first)


def arriving(spark: SparkSession, whole: DataFrame, name: str, column: str, parts: int,
             newest_first: bool = False) -> Iterator[DataFrame]:
    x = F.col(column).cast("double")
    cuts = whole.agg(F.percentile_approx(x, [i / parts for i in range(1, parts)], 1000)).head()[0] or []
    src = scratch_path(spark, f"arriving-{name}")
    part = F.lit(0)
    for c in cuts:
        part = part + F.coalesce(x > c, F.lit(False)).cast("int")
    for k in reversed(range(parts)) if newest_first else range(parts):
        whole.filter(part == k).write.mode("overwrite").parquet(f"{src}/part-{k}")
        yield spark.readStream.schema(whole.schema).parquet(f"{src}/*")


def stream_rewards_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 in two runs: the second continues the first and reads only the rest."""
    base, out = scratch_path(spark, "rewards-resumed"), None
    for source in in_parts(spark, sf_dir, "conversations", "conv_id", 2):
        out = stream_answer_scores(spark, sf_dir, source, base)
    return out


def stream_ledger_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2 in two runs over one ledger."""
    base, out = scratch_path(spark, "ledger-resumed"), None
    for source in in_parts(spark, sf_dir, "embeddings", "vec_id", 2):
        out = stream_ledger(spark, sf_dir, source, base)
    return out


RUNNING_SCHEMA = "id long, generate_seq string, prior_count long"
COUNT_STATE = "count long"


def _running_count(key, batches: Iterator[pd.DataFrame], state: GroupState):
    seen = state.get[0] if state.exists else 0
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["step", "pos"])
    rows = rows.assign(prior_count=range(seen, seen + len(rows)))
    state.update((seen + len(rows),))
    yield rows[["id", "generate_seq", "prior_count"]]


def stream_running_count(spark: SparkSession, sf_dir: str, method: str = "table") -> DataFrame:
    """ST2 ``running_count``: prior occurrences of each sequence across
    batches; rows are ordered by (step, pos) inside each batch.

    ``table`` (default, skew-safe): each micro-batch runs the two-level batch
    count (``ledger.prior_counts``) and adds the per-sequence totals of the
    earlier batches, kept in a keyed log in the shared folder (what a batch
    writes follows the batch); a hot sequence is never gathered into one task.
    ``state``: ``applyInPandasWithState`` keyed by sequence — simpler, but a
    sequence's rows of one micro-batch form one pandas group, so a hot key is
    bounded only by the trigger size.
    """
    scored = _design_stream(spark, sf_dir).select("id", "generate_seq", "step", "pos")
    if method == "state":
        counted = scored.groupBy("generate_seq").applyInPandasWithState(
            _running_count, RUNNING_SCHEMA, COUNT_STATE, "append", GroupStateTimeout.NoTimeout)
        return run_available(counted, "stream_running_count")
    if method != "table":
        raise ValueError("method must be 'table' or 'state'")
    return _running_count_by_tables(scored, "stream_running_count")


def _running_count_by_tables(scored: DataFrame, name: str) -> DataFrame:
    spark = scored.sparkSession
    base = scratch_path(spark, name)
    out, ckpt, key = f"{base}/rows", f"{base}/_checkpoint", "generate_seq"
    schema = StructType([scored.schema[key], StructField("total", LongType())])
    log = KeyedLog(spark, f"{base}/totals", schema, [key], totals([key], "total"))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            prev = log.read(batch_id - 1, keys_of=batch).select(F.col(key).alias("_k"), "total")
            ranked = ledger.prior_counts(batch, key=key)
            rows = (ranked.join(prev, ranked[key].eqNullSafe(prev["_k"]), "left")
                    .select("id", key, (F.col("prior_count") + F.coalesce("total", F.lit(0)))
                            .alias("prior_count")))
            # Keyed by batch id, so a retried batch overwrites its own output.
            rows.write.mode("overwrite").parquet(f"{out}/b={batch_id}")
            log.append(batch.groupBy(key).agg(F.count(F.lit(1)).alias("total")), batch_id)
        finally:
            batch.unpersist()

    finish(scored.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt)
           .trigger(availableNow=True).start())
    schema = spark.createDataFrame([], RUNNING_SCHEMA).schema
    return read_written(spark, out, schema).select("id", key, "prior_count")


def _as_utc_instant(ts, dtype):
    """Zone-less event time → instant, reading the wall clock as UTC."""
    if isinstance(dtype, TimestampNTZType):
        return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")
    return ts


def _as_utc_wallclock(ts):
    """Instant → zone-less UTC wall clock (independent of the session zone)."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))


def stream_windowed_report(spark: SparkSession, sf_dir: str, window: str = "1 day",
                           source: DataFrame | None = None, base: str | None = None) -> DataFrame:
    """ST4: per tumbling window and event type: count, sum and mean of value.

    No watermark, so no event is dropped however late it arrives: the result is
    the batch result for any order of files.  State is one row per window and
    event type.  Update mode, so the last (still open) window is reported too.  Event
    times without a zone are read as UTC and the window bounds are returned
    the same way, so the result does not depend on the session time zone.
    """
    ev = read_stream(spark, sf_dir, "events") if source is None else source
    ev = ev.withColumn("ts", _as_utc_instant(F.col("ts"), ev.schema["ts"].dataType))
    agg = (ev
           .groupBy(F.window("ts", window).alias("w"), "event_type")
           .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total_value"),
                F.avg("value").alias("mean_value"))
           .select(_as_utc_wallclock(F.col("w.start")).alias("window_start"),
                   _as_utc_wallclock(F.col("w.end")).alias("window_end"),
                   "event_type", "n", "total_value", "mean_value"))
    return run_available(agg, "stream_windowed_report", mode="update", base=base,
                         keys=["window_start", "window_end", "event_type"])


def stream_windowed_report_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4 over three parts that arrive newest first, a run for each."""
    base, out = scratch_path(spark, "windows-batches"), None
    for source in in_parts(spark, sf_dir, "events", "event_id", 3, newest_first=True):
        out = stream_windowed_report(spark, sf_dir, source=source, base=base)
    return out


def _events(source: DataFrame) -> DataFrame:
    return source.withColumn("ts", _as_utc_instant(F.col("ts"), source.schema["ts"].dataType))


def stream_windowed_report_watermarked(spark: SparkSession, sf_dir: str, window: str = "1 day",
                                       delay: str = "6 hours", progress: list[dict] | None = None) -> DataFrame:
    """ST4 with bounded state: three parts of the events arrive, the newest first, so
    that most of what follows is late; a run for each part, and the report of all."""
    base, taken = scratch_path(spark, "windows-watermarked"), None
    out = None
    for source in in_parts(spark, sf_dir, "events", "event_id", 3, newest_first=True):
        taken = lateness.take_in(_events(source), "ts", delay, base)
        out = lateness.windowed_report(taken, ["event_type"], "value", window, progress)
    return out.select(_as_utc_wallclock(F.col("w.start")).alias("window_start"),
                      _as_utc_wallclock(F.col("w.end")).alias("window_end"), "event_type", "n",
                      F.col("total").alias("total_value"), F.col("mean").alias("mean_value"))


def stream_sessions(spark: SparkSession, sf_dir: str, gap: str = "12 hours", delay: str = "1 day",
                    progress: list[dict] | None = None) -> DataFrame:
    """ST4 for sessions: events of a user that follow one another within ``gap``, from
    parts by event value, so that times arrive mixed and many are late."""
    base, out = scratch_path(spark, "sessions"), None
    for source in in_parts(spark, sf_dir, "events", "value", 3):
        taken = lateness.take_in(_events(source), "ts", delay, base)
        out = lateness.session_report(taken, "user_id", "value", gap, progress)
    return out.select("user_id", _as_utc_wallclock(F.col("session_start")).alias("session_start"),
                      _as_utc_wallclock(F.col("session_end")).alias("session_end"), "n",
                      F.col("total").alias("total_value"))


#: When the first conversation's prompt is shown (seconds; fixture).
FIRST_SHOWN = 1_700_000_000


def stream_prompts_joined(spark: SparkSession, sf_dir: str, progress: list[dict] | None = None) -> DataFrame:
    """JN10 on arriving tables, scored as in J08.  A conversation's prompt (that of its
    first turn) is shown a minute after the last conversation's, its completions follow
    by the second; prompts arrive in order, completions the newest first."""
    comp = fx.completions(spark, sf_dir)
    fields = ["keywords", "classes", "class_confidences"]
    shown = F.timestamp_seconds(F.lit(FIRST_SHOWN) + F.col("conv_id") * 60)
    prompts = comp.groupBy("conv_id").agg(F.min_by(F.struct(*fields), "turn").alias("p")) \
        .select("conv_id", shown.alias("shown"), "p.*")
    written = comp.drop(*fields).withColumn("written", F.timestamp_seconds(F.lit(FIRST_SHOWN) + F.col("conv_id") * 60 + F.col("turn")))
    base, out = scratch_path(spark, "prompts-joined"), None
    arrivals = zip(arriving(spark, prompts, "prompts", "conv_id", 3),
                   arriving(spark, written, "completions", "conv_id", 3, newest_first=True))
    for p, c in arrivals:
        out = lateness.joined_prompts(lateness.take_in(c, "written", "5 minutes", f"{base}/completions"),
                                      lateness.take_in(p, "shown", "5 minutes", f"{base}/prompts"),
                                      "conv_id", "30 minutes", f"{base}/joined", progress)
    return answers.score_answers(out, keep=["conv_id", "turn", "step"])
