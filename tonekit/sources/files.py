"""File sources and sinks.

Every reader returns a lazy DataFrame so Catalyst can prune columns and push
filters into the Parquet scan; every writer is a plain DataFrameWriter call so the
commit protocol makes output atomic per job.
"""
from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, root: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A1/A2: one Parquet table by name under ``root``; optional explicit column subset."""
    df = spark.read.parquet(os.path.join(root, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def read_glob(spark: SparkSession, pattern: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """A3: a glob (``emotions/chunk_*.parquet``) or a list of paths read as one table."""
    paths = [pattern] if isinstance(pattern, str) else list(pattern)
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """A3 fallback: the first path (or glob) that exists, e.g. full labels, then a sample.

    Asked of Spark, so any file system the session reads will do."""
    for p in paths:
        try:
            spark.read.format("binaryFile").load(p)
            return p
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError(f"none of {list(paths)} exists")


def read_json_records(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """A4: files holding one JSON array of nested records each, concatenated by name."""
    reader = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(list(paths))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; an explicit schema avoids the inference pass."""
    reader = spark.read.option("header", "true")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header row, no index column.  Left partitioned: one file per task."""
    df.write.mode(mode).option("header", "true").csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """ZSTD Parquet, optionally partitioned (e.g. by ``year`` for partition pruning)."""
    w = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


#: Empty file that says that a folder was written to the end; hidden from readers by its name.
COMMITTED = "_COMMITTED"


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of the session's Hadoop configuration: local disk, HDFS or an object store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def folder_and_glob(spark: SparkSession, path: str, glob: str) -> tuple[str, str]:
    """(folder, glob) of a table's files, for readers that want a folder: a table that is one file lies
    in its parent and matches its name."""
    fs, p = _hadoop(spark, path)
    if fs.exists(p) and fs.getFileStatus(p).isFile():
        return p.getParent().toString(), p.getName()
    return path, glob


def committed(spark: SparkSession, path: str) -> bool:
    """True if ``path`` was written to the end: by :func:`write_committed`, or by a Spark job that left its own mark."""
    marks = [_hadoop(spark, f"{path.rstrip('/')}/{name}") for name in (COMMITTED, "_SUCCESS")]
    return any(fs.exists(p) for fs, p in marks)


def write_committed(df: DataFrame, path: str, rebuild: bool = False, partition_by: Sequence[str] = ()) -> bool:
    """Idempotent build step. Skipped if ``path`` was written to the end, unless ``rebuild``;
    True if it was written now.

    The table is written beside ``path``, takes its place when whole, and is then marked. A folder
    without the mark is what a crashed run left: it is replaced. While a table is rebuilt the old one
    stays readable until the new one is whole.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    if not rebuild and committed(spark, path):
        return False
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    # Spark's own mark would travel with the files, and a move need not be atomic in an object store
    w = df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(staging)
    fs, final = _hadoop(spark, path)
    if fs.exists(final):
        fs.delete(final, True)
    if not fs.rename(_hadoop(spark, staging)[1], final):
        raise OSError(f"{staging} could not be moved to {path}")
    fs.create(_hadoop(spark, f"{path}/{COMMITTED}")[1], True).close()
    return True


def write_if_absent(df: DataFrame, path: str, rebuild: bool = False, partition_by: Sequence[str] = ()) -> None:
    """:func:`write_committed` for callers that need no answer."""
    write_committed(df, path, rebuild, partition_by)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One text per line; blank lines dropped (trailing newline already stripped)."""
    return spark.read.text(path).withColumnRenamed("value", "text").filter(F.trim("text") != "")


def span_summary(df: DataFrame, id_col: str, who_col: str, ts_col: str) -> DataFrame:
    """Row count, distinct authors and the covered date span, in one aggregate."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(who_col).alias("members"),
        F.to_date(F.min(ts_col)).alias("first"),
        F.to_date(F.max(ts_col)).alias("last"),
        (F.count(F.lit(1)) - F.count_distinct(id_col)).alias("dup_ids"),
    )


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, mode: str = "overwrite",
                   sort: bool = True) -> None:
    """D1 at scale: store messages and their scores bucketed (and sorted) by the id with
    the same bucket count, so the fact-to-fact join reads co-located buckets and
    shuffles neither side.  Needs a catalog table (``saveAsTable``)."""
    w = df.write.mode(mode).option("compression", "zstd").bucketBy(buckets, key)
    if sort:
        w = w.sortBy(key)
    w.saveAsTable(table)
