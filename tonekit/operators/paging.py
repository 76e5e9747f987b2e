"""Row numbers and pages of a total order (F14), without a global sort or a single task.

The rows are dealt out by ranges of the order (Spark samples the cuts), sorted within each range
and written once with their place in it; the sizes of the ranges, one number each, turn the place
into a row number. A page then reads the files of the one or two ranges it lies in.
"""
from __future__ import annotations

import bisect
import itertools
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .joins import fixed_broadcast

RANGE, PLACE = "_range", "_place"


@dataclass(frozen=True)
class RowIndex:
    """An ordered table at ``path``: ``starts[i]`` rows lie before range ``ranges[i]``, ``size`` in all."""

    spark: SparkSession
    path: str
    schema: object
    ranges: tuple[int, ...]
    starts: tuple[int, ...]
    size: int

    def _table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def rows(self, name: str = "row") -> DataFrame:
        """Every row with its number, from 0. The table of starts has one row a range."""
        starts = self.spark.createDataFrame(list(zip(self.ranges, self.starts)), f"{RANGE} int, _start long")
        return self._table().join(fixed_broadcast(starts), RANGE).withColumn(
            name, F.col("_start") + F.col(PLACE)).drop(RANGE, PLACE, "_start")

    def between(self, first: int, end: int, name: str = "row") -> DataFrame:
        """The rows numbered ``first`` to ``end - 1``: only their ranges are listed and opened, and
        the place in the range is a filter that Parquet's row groups are skipped by."""
        a = max(bisect.bisect_right(self.starts, first) - 1, 0)
        b = bisect.bisect_left(self.starts, end)
        out = None
        for r, start in list(zip(self.ranges, self.starts))[a:b] if first < end else []:
            part = self._table().filter((F.col(RANGE) == r) & F.col(PLACE).between(first - start, end - start - 1)).select(
                "*", (F.col(PLACE) + F.lit(start)).alias(name)).drop(RANGE, PLACE)
            out = part if out is None else out.unionByName(part)
        return self.rows(name).filter("false") if out is None else out

    def page(self, number: int, size: int, name: str = "row") -> DataFrame:
        """Page ``number`` (from 0) of ``size`` rows, what ``LIMIT size OFFSET number * size`` gives."""
        return self.between(number * size, (number + 1) * size, name)


def row_index(df: DataFrame, order: Sequence[str | Column], path: str | None = None, ranges: int | None = None) -> RowIndex:
    """Write ``df`` in the order of the given keys and number its rows.

    The keys should end in a unique one, as pages are only repeatable over a total order; rows equal
    in all keys share a range, so a key that most rows have needs an id behind it. Nulls come
    first (``asc_nulls_last`` and the like change that). ``path``: a new folder; by default one in
    the shared folder of the session. ``ranges``: how many, by default the session's shuffle partitions.
    """
    spark = df.sparkSession
    path = path or os.path.join(checkpoint_dir(spark), f"rows-{uuid.uuid4().hex}")
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # the id counts up within a partition from a start that depends on its number alone
    placed = dealt.select("*", F.spark_partition_id().alias(RANGE),
                          F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(PLACE))
    placed.write.partitionBy(RANGE).option("compression", "zstd").parquet(path)
    schema = placed.schema
    sizes = sorted((r[RANGE], r["n"]) for r in spark.read.schema(schema).parquet(path).groupBy(RANGE).agg(
        F.count(F.lit(1)).alias("n")).collect())  # one row a range
    ends = list(itertools.accumulate(n for _, n in sizes))
    return RowIndex(spark, path, schema, tuple(r for r, _ in sizes), tuple([0, *ends[:-1]] if ends else ()), ends[-1] if ends else 0)
