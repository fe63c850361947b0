"""Late rows kept: arrival is judged before anything holds state.

A watermark bounds the state of windows, sessions and joins by dropping what comes
behind it.  ``take_in`` drains a source into two tables first: rows whose event time is
less than ``delay`` behind the latest time of earlier batches are on time, all
others (and rows without a time, or from before 1970, where watermarks begin) are late.  A stream over the on-time table then never
drops a row, since its watermark is never ahead of that mark (``sinks.finish``
checks its records), and reports add the late table back: what was emitted is
merged with what the late rows and the still open windows contribute.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.streaming.files import exists
from skein.streaming.sinks import finish, read_written, run_available


@dataclass(frozen=True)
class Taken:
    """The tables of an intake: ``ontime`` and ``late`` below ``base``."""

    spark: SparkSession
    base: str
    schema: StructType
    time: str
    delay: str

    def _table(self, kind: str) -> DataFrame:
        return read_written(self.spark, f"{self.base}/{kind}", self.schema).select(*self.schema.names)

    @property
    def late(self) -> DataFrame:
        return self._table("late")

    @property
    def ontime(self) -> DataFrame:
        return self._table("ontime")

    def stream(self) -> DataFrame:
        """The on-time table as a stream with its watermark."""
        return self.spark.readStream.schema(self.schema).parquet(f"{self.base}/ontime/*") \
            .select(*self.schema.names).withWatermark(self.time, self.delay)


def take_in(stream: DataFrame, time: str, delay: str, base: str) -> Taken:
    """Drain ``stream`` into the on-time and the late table below ``base``.

    Run again with the same ``base``, it goes on where it stopped.  The latest time
    seen is written with each batch, so a batch that is run again is judged alike.
    """
    spark = stream.sparkSession

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            seen = None
            if batch_id:
                seen = spark.read.schema("seen timestamp").parquet(f"{base}/seen/b={batch_id - 1}").head()[0]
            latest = batch.agg(F.max(time).cast("timestamp").alias("seen"))
            mark = F.lit(seen).cast("timestamp")
            latest.select(F.greatest("seen", mark).alias("seen")).write.mode("overwrite") \
                .parquet(f"{base}/seen/b={batch_id}")
            mark = F.coalesce(mark - F.expr(f"interval {delay}"), F.timestamp_seconds(F.lit(0)))
            late = F.col(time).isNull() | (F.col(time) <= F.greatest(mark, F.timestamp_seconds(F.lit(0))))
            for kind, part in (("ontime", ~late), ("late", late)):
                batch.filter(F.coalesce(part, F.lit(False))).write.mode("overwrite").parquet(f"{base}/{kind}/b={batch_id}")
        finally:
            batch.unpersist()

    finish(stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", f"{base}/_intake")
           .trigger(availableNow=True).start())
    return Taken(spark, base, stream.schema, time, delay)


def _started(taken: Taken) -> bool:
    return exists(taken.spark, f"{taken.base}/ontime")


# -- tumbling windows ------------------------------------------------------------

def _window_sums(rows: DataFrame, time: str, by: list[str], value: str, window: str) -> DataFrame:
    return rows.groupBy(F.window(time, window).alias("w"), *by).agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("n_values"), F.sum(value).alias("total"))


def windowed_report(taken: Taken, by: list[str], value: str, window: str,
                    progress: list[dict] | None = None) -> DataFrame:
    """w, ``by``, n, total, mean of ``value`` per window, of all rows taken in.

    Closed windows come from an append-mode stream, whose state is one row per open
    window and group.  The windows that it has not emitted yet and the late rows are
    summed up from their tables and merged with it.
    """
    closed, name = None, f"{taken.base}/windows"
    if _started(taken):
        closed = run_available(_window_sums(taken.stream(), taken.time, by, value, window), "windows",
                               base=name, progress=progress)
    parts = _window_sums(taken.late, taken.time, by, value, window)
    if closed is not None:
        every = _window_sums(taken.ontime, taken.time, by, value, window)
        keys = [every["w"] == closed["w"], *(every[c].eqNullSafe(closed[c]) for c in by)]
        cond = keys[0]
        for k in keys[1:]:
            cond = cond & k
        parts = parts.unionByName(every.join(closed, cond, "left_anti")).unionByName(closed)
    return parts.groupBy("w", *by).agg(F.sum("n").alias("n"), F.sum("n_values").alias("_n"), F.sum("total").alias("total")) \
        .select("w", *by, "n", "total", (F.col("total") / F.when(F.col("_n") > 0, F.col("_n"))).alias("mean"))


# -- sessions ----------------------------------------------------------------------

def _sessions(rows: DataFrame, time: str, user: str, value: str, gap: str) -> DataFrame:
    return rows.groupBy(user, F.session_window(time, gap).alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def session_report(taken: Taken, user: str, value: str, gap: str, progress: list[dict] | None = None) -> DataFrame:
    """``user``, session_start, session_end (the last time plus ``gap``), n, total: the
    sessions of all rows taken in.

    Closed sessions come from an append-mode stream.  A user's rows from behind the
    last closed session on are still open; those and the late rows form sessions of
    their own, and what overlaps is merged: sessions are intervals with sums, so a
    late row that bridges two closed sessions makes them one.
    """
    parts = _sessions(taken.late, taken.time, user, value, gap)
    if _started(taken):
        closed = run_available(_sessions(taken.stream(), taken.time, user, value, gap), "sessions",
                               base=f"{taken.base}/sessions", progress=progress)
        until = closed.groupBy(F.col(user).alias("_u")).agg(F.max("s.end").alias("_until"))
        rows = taken.ontime
        rows = rows.join(until, rows[user].eqNullSafe(until["_u"]), "left") \
            .filter(F.col("_until").isNull() | (F.col(taken.time) > F.col("_until"))).select(*taken.ontime.columns)
        parts = parts.unionByName(_sessions(rows, taken.time, user, value, gap)).unionByName(closed)
    order = Window.partitionBy(user).orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int")
    return parts.select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "total") \
        .withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(order)) \
        .groupBy(user, "_island").agg(F.min("start").alias("session_start"), F.max("end").alias("session_end"),
                                      F.sum("n").alias("n"), F.sum("total").alias("total")).drop("_island")


# -- joins ---------------------------------------------------------------------------

def _joined(completions: DataFrame, prompts: DataFrame, key: str, c_time: str, p_time: str, within: str) -> DataFrame:
    p = prompts.withColumnRenamed(key, "_pk")
    near = (F.col(c_time) >= F.col(p_time)) & (F.col(c_time) <= F.col(p_time) + F.expr(f"interval {within}"))
    return completions.join(p, (completions[key] == p["_pk"]) & near).drop("_pk")


def joined_prompts(completions: Taken, prompts: Taken, key: str, within: str, base: str,
                   progress: list[dict] | None = None) -> DataFrame:
    """JN10 on arriving tables: each completion with the prompt of its key that was
    shown at most ``within`` before it, whichever of the two arrives first.

    On-time rows meet in a stream-stream join, whose state holds the rows that a row
    to come can still match.  Late rows of either side are joined from their tables
    with all rows of the other side.  The result is the batch join of all rows.
    """
    c_time, p_time = completions.time, prompts.time
    late = _joined(completions.late, prompts.late.unionByName(prompts.ontime), key, c_time, p_time, within) \
        .unionByName(_joined(completions.ontime, prompts.late, key, c_time, p_time, within))
    if not (_started(completions) and _started(prompts)):
        return late
    met = run_available(_joined(completions.stream(), prompts.stream(), key, c_time, p_time, within), "joined",
                        base=base, progress=progress)
    return met.unionByName(late)
