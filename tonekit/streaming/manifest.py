"""Resumable scoring of files that may change.

``out`` holds three things: ``scores/gen=<n>`` (the rows of one step, each with the file it came
from), ``manifest/gen=<n>`` (what that step did to which file, written last) and, after
:func:`merge`, one compacted table. A file is known by name, size and time; a step takes files
that are new or differ from what the manifest says, or are gone. A row counts if the manifest's
last word on its file names the row's step, so rows of a replaced or deleted file drop out at
once, as do rows of a step that was killed before its manifest was written; its number is used
again and its folder overwritten.

A step's manifest is one small file, moved into place by the writer's commit: it is there or not.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import write_committed, write_parquet

#: Column that a scorer must pass on: the file a row came from.
FILE = "_file"
ENTRY = "file string, bytes long, modified timestamp, rows long, live boolean, gen long"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:  # works for any file system the session reads
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def listed(spark: SparkSession, source: str, glob: str = "*.parquet") -> DataFrame:
    """(file, bytes, modified, path) of the files under ``source``, a folder or a single file; nothing is
    opened. ``file`` is the name as rows know it (escaped as in a URL), ``path`` the one to read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
            .load(source).select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("bytes"),
                                 F.col("modificationTime").alias("modified"), "path"))


def state(spark: SparkSession, out: str) -> DataFrame:
    """The manifest's last word on every file: file, bytes, modified, rows, live, gen."""
    log = _read(spark, f"{out}/manifest", ENTRY)
    last = Window.partitionBy("file").orderBy(F.desc("gen"))
    return log.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")


def changes(spark: SparkSession, source: str, out: str, glob: str = "*.parquet") -> DataFrame:
    """(file, bytes, modified, path, live): files to score (live) and files that are gone (not live)."""
    now, known = listed(spark, source, glob), state(spark, out).filter("live").select(
        "file", F.col("bytes").alias("_b"), F.col("modified").alias("_m"))
    both = now.join(known, "file", "full")
    same = F.col("bytes").eqNullSafe(F.col("_b")) & F.col("modified").eqNullSafe(F.col("_m"))
    return both.filter(~same).select("file", "bytes", "modified", "path", F.col("bytes").isNotNull().alias("live"))


def update(spark: SparkSession, source: str, scorer: Callable[[DataFrame], DataFrame], out: str,
           glob: str = "*.parquet", max_files: int = 64, max_steps: int | None = None) -> dict[str, int]:
    """Bring the scores at ``out`` up to date with the files under ``source``, ``max_files`` a step.

    ``scorer`` gets the rows of a step's files with a column ``_file`` and must keep that column.
    A killed call loses the step it was in; the next call goes on after the last finished one.
    ``max_steps`` ends a call early. Returns steps, files scored, files gone, rows written.
    The names of changed files come to the driver, as they do for any read of those files, and how many
    rows each of a step's files gave.
    """
    out = out.rstrip("/")
    todo = sorted(changes(spark, source, out, glob).collect(), key=lambda r: r.file)
    gen = (_read(spark, f"{out}/manifest", ENTRY).agg(F.max("gen")).first()[0] or 0) + 1
    done = {"steps": 0, "scored": 0, "gone": 0, "rows": 0}
    for at in range(0, len(todo), max_files):
        if max_steps is not None and done["steps"] >= max_steps:
            break
        step = todo[at:at + max_files]
        live = [r.path for r in step if r.live]
        if live:
            rows = spark.read.parquet(*live).withColumn(FILE, F.col("_metadata.file_path"))
            scored = scorer(rows)
            if FILE not in scored.columns:
                raise ValueError(f"the scorer must keep the column {FILE}")
            write_parquet(scored, f"{out}/scores/gen={gen}")
            counts = {r.file: r.rows for r in spark.read.parquet(f"{out}/scores/gen={gen}").groupBy(
                F.col(FILE).alias("file")).agg(F.count(F.lit(1)).alias("rows")).collect()}  # a row a file of the step
        else:
            counts = {}
        # at most ``max_files`` rows, in one file: the manifest of a step appears in one move. Nothing is joined or
        # summed up below the coalesce, where one task would hold a table for each of the partitions it takes in.
        log = spark.createDataFrame([(r.file, r.bytes, r.modified, counts.get(r.file, 0), r.live) for r in step],
                                    "file string, bytes long, modified timestamp, rows long, live boolean")
        write_parquet(log.coalesce(1), f"{out}/manifest/gen={gen}")
        done["rows"] += sum(counts.get(r.file, 0) for r in step)
        done["steps"] += 1
        done["scored"] += len(live)
        done["gone"] += len(step) - len(live)
        gen += 1
    return done


def current(spark: SparkSession, out: str) -> DataFrame:
    """The rows that count: of every live file, those of its last step."""
    out = out.rstrip("/")
    live = state(spark, out).filter("live and rows > 0").select(F.col("file").alias(FILE), "gen")
    rows = spark.read.parquet(f"{out}/scores")
    return rows.join(live, [FILE, "gen"], "left_semi").drop("gen")


def merge(spark: SparkSession, out: str, final: str, key: str | None = None, files: int | None = None) -> DataFrame:
    """The chunks merged into one table at ``final`` (a committed step, rewritten on each call);
    with ``key``, range-partitioned and sorted by it into ``files`` files, so that a look-up reads few."""
    rows = current(spark, out).drop(FILE)
    if key:
        rows = (rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key)).sortWithinPartitions(key)
    write_committed(rows, final, rebuild=True)
    return spark.read.parquet(final)
