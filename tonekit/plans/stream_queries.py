"""Incremental and streaming queries (A11, streaming weekly batteries).

Each call starts from a new folder, so it reads its whole table; that calls with one folder go on
where the last one stopped, and notice changed files, is what ``rescored_files`` shows."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from .. import constants as K
from ..operators.scoring import lexicon_scores
from ..session import checkpoint_dir
from ..sources.files import read_table
from ..streaming import manifest as M
from ..streaming.incremental import run_weekly_stream, weekly_battery
from ..streaming.windows import all_weeks, run_weekly_windows
from . import oracle_views as O
from .registry import register
from .views import msgs_from_events

LABELS = [*K.EMOTIONS, *K.SENTIMENTS]


def _score_docs(df):
    rows = df.select(F.col("doc_id").alias("msg_id"), "text", M.FILE)
    return lexicon_scores(rows).select("msg_id", *LABELS, M.FILE)


def _new(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


_SCORES = O.with_views("SELECT msg_id, " + ", ".join(f"ROUND({c}, 6) AS {c}" for c in LABELS) + " FROM s",
                       s=O.lexicon_sql("SELECT doc_id AS msg_id, text FROM documents"))


@register("resumable_scores", _SCORES)
def resumable_scores(spark, root):
    """The documents scored file by file under a manifest, and merged into one table."""
    out = _new(spark, "document-scores")
    M.update(spark, os.path.join(root, "documents.parquet"), _score_docs, out)
    return M.merge(spark, out, f"{out}/final", key="msg_id")


#: Files of a part table, and bytes of a row group: steps take a few files each, so their number must not
#: grow with the documents, and a step of few files still gives every core some row groups.
PART_FILES, ROW_GROUP = 8, 8 << 20


def _part_writer(df):
    """Rows dealt out by their id, so that a part has as many files however many tasks read the documents."""
    return df.repartition(PART_FILES, "doc_id").write.mode("overwrite").option("parquet.block.size", ROW_GROUP)


@register("rescored_files", _SCORES)
def rescored_files(spark, root):
    """The same scores over four part tables of the documents, reached by a first call that ends
    early, a part with other texts that is replaced, a part that is deleted and one that comes later."""
    src, out = _new(spark, "document-parts"), _new(spark, "part-scores")
    docs = read_table(spark, root, "documents", ["doc_id", "text"]).withColumn("part", F.pmod(F.hash("doc_id"), F.lit(4)))
    old = docs.withColumn("text", F.when(F.col("part") == 2, F.reverse("text")).otherwise(F.col("text")))
    _part_writer(old.filter("part < 3")).partitionBy("part").parquet(src)
    _part_writer(docs.filter("part = 0").withColumn("doc_id", -F.col("doc_id") - 1).drop("part")).parquet(f"{src}/part=9")
    M.update(spark, src, _score_docs, out, max_files=2, max_steps=2)
    for part in (2, 3):
        _part_writer(docs.filter(F.col("part") == part).drop("part")).parquet(f"{src}/part={part}")
    docs.filter("false").drop("part").write.mode("overwrite").parquet(f"{src}/part=9")
    M.update(spark, src, _score_docs, out, max_files=3)
    return M.merge(spark, out, f"{out}/final")


@register("weekly_stream", O.with_views("""SELECT wk, party, count(*) AS n, ROUND(avg(anger), 6) AS anger,
       ROUND(avg(flag), 6) AS share_angry
FROM (SELECT CAST(ts AS DATE) - CAST(isodow(ts) - 1 AS INTEGER) AS wk, party, anger, CASE WHEN anger > 0.5 THEN 1 ELSE 0 END AS flag
      FROM m) x GROUP BY ALL""", m=O.MSGS))
def weekly_stream(spark, root):
    """Streaming extension: Monday-aligned weekly battery over the event feed, every week of
    the backlog, late rows included."""
    out = run_weekly_stream(spark, os.path.join(root, "events.parquet"), msgs_from_events, _new(spark, "weekly-sums"))
    return weekly_battery(spark.read.parquet(out))


SLICE_DAYS, LATE_SLICES, WATERMARK_DAYS = 8, 2, 3


@register("weekly_windows", O.with_views(f"""SELECT wk, party, count(*) AS n, count(*) FILTER (NOT late AND over) AS n_closed,
       count(*) FILTER (NOT late AND NOT over) AS n_open, count(*) FILTER (late) AS n_late, ROUND(avg(anger), 6) AS anger,
       ROUND(avg(CAST(anger > 0.5 AS INTEGER)), 6) AS share_angry
FROM (SELECT m.wk, party, anger, coalesce(m.wk + 7 + INTERVAL {WATERMARK_DAYS} DAY <= w.seen, false) AS late,
             m.wk + 7 + INTERVAL {WATERMARK_DAYS} DAY <= (SELECT max(ts) FROM m) AS over
      FROM m JOIN w USING (slice)) x GROUP BY ALL""",
    m=f"""SELECT CAST(ts AS DATE) - CAST(isodow(ts) - 1 AS INTEGER) AS wk, party, anger, ts,
       CAST(epoch(ts) AS BIGINT) // {86400 * SLICE_DAYS} + CASE WHEN msg_id % 10 = 0 THEN {LATE_SLICES} ELSE 0 END AS slice FROM ({O.MSGS}) q""",
    w="""SELECT slice, max(newest) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
FROM (SELECT slice, max(ts) AS newest FROM m GROUP BY slice) x"""))
def weekly_windows(spark, root):
    """Streaming extension: the weekly battery from event-time state. The events land in slices of
    eight days, a tenth of them two slices late, and the stream runs after each; rows of closed
    weeks, open weeks and late rows add up to all events."""
    src, out = _new(spark, "event-slices"), _new(spark, "weekly-windows")
    events = read_table(spark, root, "events")
    late = F.when(F.col("event_id") % 10 == 0, LATE_SLICES).otherwise(0)
    sliced = events.withColumn("slice", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (86400 * SLICE_DAYS)) + late)
    for r in sliced.select("slice").distinct().orderBy("slice").collect():  # one a slice of days
        sliced.filter(F.col("slice") == r.slice).drop("slice").write.mode("append").parquet(src)
        run_weekly_windows(spark, src, msgs_from_events, out, delay=f"{WATERMARK_DAYS} days")
    return all_weeks(spark, out)
