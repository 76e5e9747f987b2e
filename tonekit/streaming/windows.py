"""Weekly windows with event-time state (streaming extension).

A feed of messages is added up per week and group in Spark's state store. A watermark (newest
event seen, less a delay) says when a week is over: its row is then given out once and its state
removed. Rows that come for a week that is over go to a place of their own, counted the same way,
so nothing is lost: closed weeks, late rows and weeks still open add up to all rows seen.

Tasks first add up their own rows per week and group, without state, so that what is shuffled to
the state is a row per task and key, and a week or group with most of the rows is no hot key.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import calendar as cal
from .incremental import file_stream

SUMS = "n long, scored long, total double, angry long"
GIVEN = f"wk date, grp string, {SUMS}, kind string"
DELAY = "14 days"
_WEEK_MS = 7 * 24 * 3600 * 1000


def _plain(texts) -> pd.Series:
    """Strings and nulls as Python objects; a column of a string type can be chunked, which the state's writer refuses."""
    return pd.Series([None if pd.isna(x) else x for x in texts], dtype=object)


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a batch added up per week and group, and one row without a week that carries the
    newest time. Spark drops rows whose event time lies before the watermark ahead of any state;
    the sums have no event time, so that late ones reach :func:`_advance`, which tells them apart."""
    for b in batches:
        if len(b):
            out = b.groupby(["wk", "grp"], dropna=False, sort=False).agg(
                n=("n", "sum"), scored=("scored", "sum"), total=("total", "sum"), angry=("angry", "sum")).reset_index()
            out["grp"] = _plain(out["grp"])
            out["clock"] = pd.Series(pd.NaT, index=out.index, dtype="datetime64[us]")
            tick = pd.DataFrame({"wk": [None], "grp": _plain([None]), "n": [0], "scored": [0], "total": [0.0], "angry": [0],
                                 "clock": pd.Series([b["clock"].max()], dtype="datetime64[us]")})
            yield out
            yield tick


def _advance(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """One key (week, group): add, close or divert. Called with the key's new rows, or without any
    when the watermark has passed the end of its week."""
    wk, grp = key
    if wk is None:
        return
    end = pd.Timestamp(wk).value // 1_000_000 + _WEEK_MS
    over = state.hasTimedOut or end <= state.getCurrentWatermarkMs()
    held = state.get if state.exists else (0, 0, 0.0, 0)
    new = [0, 0, 0.0, 0]
    for b in batches:
        new = [int(new[0] + b.n.sum()), int(new[1] + b.scored.sum()), float(new[2] + b.total.sum()), int(new[3] + b.angry.sum())]
    if not over:
        state.update(tuple(x + y for x, y in zip(held, new)))
        state.setTimeoutTimestamp(end - 1)  # passes with a watermark of ``end``
        return
    out = ([(wk, grp, *held, "closed")] if state.exists else []) + ([(wk, grp, *new, "late")] if new[0] else [])
    if state.exists:
        state.remove()
    if out:
        given = pd.DataFrame(out, columns=["wk", "grp", "n", "scored", "total", "angry", "kind"])
        yield given.assign(grp=_plain(given["grp"]), kind=_plain(given["kind"]))


def run_weekly_windows(spark: SparkSession, source: str, prepare: Callable[[DataFrame], DataFrame], out: str,
                       delay: str = DELAY, glob: str = "*.parquet", max_files_per_trigger: int = 1000,
                       ts: str = "ts", score: str = "anger", group: str = "party") -> str:
    """Bring the windows at ``out`` up to date with the files under ``source`` and stop.

    Rows without a time are left out, as they belong to no week; times are from 1970 on. Closed weeks and late rows are
    appended to the Parquet folders ``kind=closed`` and ``kind=late`` (the file sink's log makes a
    micro-batch all or nothing), open weeks stay in the state; a call after a crash, or when new
    files are there, goes on from the checkpoint ``<out>.checkpoint``.
    """
    rows = prepare(file_stream(spark, source, glob, maxFilesPerTrigger=max_files_per_trigger)).filter(F.col(ts).isNotNull())
    parts = rows.select(
        cal.week_start(ts).alias("wk"), F.col(group).cast("string").alias("grp"), F.lit(1).cast("long").alias("n"),
        F.col(score).isNotNull().cast("long").alias("scored"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("total"),
        F.coalesce((F.col(score) > K.ANGRY_THRESHOLD).cast("long"), F.lit(0)).alias("angry"), F.col(ts).cast("timestamp").alias("clock"),
    ).mapInPandas(_partial, f"wk date, grp string, {SUMS}, clock timestamp").withWatermark("clock", delay)
    given = parts.groupBy("wk", "grp").applyInPandasWithState(_advance, GIVEN, SUMS, "append", "EventTimeTimeout")
    q = (given.writeStream.format("parquet").option("path", out).partitionBy("kind")
         .option("checkpointLocation", out.rstrip("/") + ".checkpoint").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def closed_and_late(spark: SparkSession, out: str) -> DataFrame:
    """wk, grp, sums, kind of what the stream has given out."""
    return spark.read.schema(GIVEN).parquet(out).select("wk", "grp", "n", "scored", "total", "angry", "kind")


def open_weeks(spark: SparkSession, out: str) -> DataFrame:
    """wk, grp, sums of the weeks that the state still holds, read from the checkpoint's state store;
    the state stays as it is, so a later run goes on with it."""
    held = spark.read.format("statestore").load(out.rstrip("/") + ".checkpoint")
    return held.select("key.*", "value.groupState.*").select("wk", "grp", "n", "scored", "total", "angry")


def all_weeks(spark: SparkSession, out: str, group: str = "party", score: str = "anger") -> DataFrame:
    """The weekly battery over every row seen: n, of these in closed weeks, still open, and late, mean
    score and share over the threshold per week and group."""
    rows = closed_and_late(spark, out).unionByName(open_weeks(spark, out).withColumn("kind", F.lit("open")))
    t = rows.groupBy("wk", F.col("grp").alias(group)).agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n_{k}")
                                 for k in ("closed", "open", "late")],
        F.try_divide(F.sum("total"), F.sum("scored")).alias(score),
        F.try_divide(F.sum("angry"), F.sum("scored")).alias("share_angry"))
    return t
