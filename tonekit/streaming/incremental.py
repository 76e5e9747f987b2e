"""Incremental paths (A11 and the streaming extension of E1/G-batteries).

* :func:`score_new_files` -- resumable scoring: a file-source stream over the raw
  message files, scored in micro-batches and appended to a Parquet sink.  The
  checkpoint records which files were done, so a rerun (after a crash or when new
  files land) scores only what is new; the file sink's commit log makes each batch
  all-or-nothing.  ``trigger(availableNow=True)`` processes the backlog and stops.
* :func:`run_weekly_stream` / :func:`weekly_battery` -- the weekly mean battery over an
  append-only feed.  Each micro-batch adds its sums per week and group, keyed by the batch
  id; reading adds them up.  No state is held and no watermark closes a week, so every
  week of the backlog is there and a late row counts whenever it comes.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import calendar as cal
from ..sources.files import folder_and_glob, write_parquet


def file_stream(spark: SparkSession, source: str, glob: str, **opts) -> DataFrame:
    """A stream of the Parquet files under the folder ``source`` (or of the one file that it is), with the
    schema they have now."""
    source, glob = folder_and_glob(spark, source, glob)
    schema = spark.read.option("pathGlobFilter", glob).parquet(source).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    for k, v in opts.items():
        r = r.option(k, v)
    return r.parquet(source)


def score_new_files(spark: SparkSession, source: str, scorer: Callable[[DataFrame], DataFrame], out: str,
                    glob: str = "*.parquet", max_files_per_trigger: int = 64) -> str:
    """Score every not-yet-scored file matching ``glob`` in folder ``source`` and
    append the scores to ``out``; returns that path.  ``out`` and the record of done files
    beside it (``<out>.checkpoint``) are shared folders; calls with the same ``out`` resume."""
    stream = file_stream(spark, source, glob, maxFilesPerTrigger=max_files_per_trigger)
    q = (scorer(stream).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", out.rstrip("/") + ".checkpoint")
         .option("compression", "zstd").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def weekly_sums(events: DataFrame, ts: str = "ts", score: str = "anger", group: str = "party") -> DataFrame:
    """Additive parts of the weekly battery: rows, scored rows, score sum and rows over the
    threshold per Monday-aligned week and group."""
    return events.groupBy(cal.week_start(ts).alias("wk"), group).agg(
        F.count(F.lit(1)).alias("n"), F.count(score).alias("scored"), F.sum(score).alias("total"),
        F.sum((F.col(score) > K.ANGRY_THRESHOLD).cast("int")).alias("angry"))


def run_weekly_stream(spark: SparkSession, source: str, prepare: Callable[[DataFrame], DataFrame], out: str,
                      glob: str = "*.parquet", max_files_per_trigger: int = 64) -> str:
    """Add the :func:`weekly_sums` of every new file under ``source`` to ``out``, one folder a
    micro-batch; a batch that is repeated after a failure overwrites its own folder."""
    def add(batch: DataFrame, batch_id: int) -> None:
        weekly_sums(prepare(batch)).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    q = (file_stream(spark, source, glob, maxFilesPerTrigger=max_files_per_trigger).writeStream.foreachBatch(add)
         .option("checkpointLocation", out.rstrip("/") + ".checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def weekly_battery(sums: DataFrame, group: str = "party", score: str = "anger") -> DataFrame:
    """n, mean score and share over the threshold per week and group, over all batches so far."""
    t = sums.groupBy("wk", group).agg(*[F.sum(c).alias(c) for c in ("n", "scored", "total", "angry")])
    return t.select("wk", group, "n", F.try_divide("total", "scored").alias(score),
                    F.try_divide("angry", "scored").alias("share_angry"))


def late_rows(sums: DataFrame, days: int = 14) -> DataFrame:
    """Per batch, the rows and how many of them were late: of a week that ended ``days`` days or
    more before the newest week of any earlier batch."""
    newest = sums.groupBy("batch").agg(F.max("wk").alias("newest"))  # one row a batch
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    seen = newest.select("batch", F.max("newest").over(before).alias("seen"))
    late = F.col("wk") < F.date_sub("seen", days)
    return sums.join(seen, "batch").groupBy("batch").agg(
        F.sum("n").alias("rows"), F.sum(F.when(late, F.col("n")).otherwise(0)).alias("late"))


def score_missing(spark: SparkSession, messages: DataFrame, out: str, scorer: Callable[[DataFrame], DataFrame],
                  id_col: str = "msg_id") -> int:
    """A11 for a static table: score only the messages whose id is not yet in the
    Parquet output at ``out`` (an anti-join on the id), then append them.  Each append
    is one job with Spark's commit protocol, so an interrupted run leaves either all
    or none of its rows and the next run picks up the rest.  Returns rows appended,
    counted as they are written."""
    todo = messages
    try:
        done = spark.read.parquet(out).select(id_col)
        todo = messages.join(done, id_col, "left_anti")
    except AnalysisException as e:  # works for any file system the session reads
        if "PATH_NOT_FOUND" not in str(e):
            raise
    seen = Observation()
    write_parquet(scorer(todo).observe(seen, F.count(F.lit(1)).alias("n")), out, mode="append")
    return int(seen.get["n"])
