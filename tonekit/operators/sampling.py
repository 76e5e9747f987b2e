"""Cuts that leave about ``n`` of the lowest hashes (A13, A14), from counts in bins."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_bin(md5: str) -> Column:
    """A bin number that grows with the hash: the length of its first 60 bits as a number, then the
    11 bits from the first one set. Bins are a thousandth of their distance from zero wide, so the
    lowest hashes are told apart however many there are."""
    return log_bin(F.conv(F.substring(md5, 1, 15), 16, 10).cast("long"))


def log_bin(x: Column) -> Column:
    """The bin of a number from 0 to 2**63 - 1, as :func:`hash_bin` has it."""
    size = F.length(F.bin(x))
    return (size * 2048 + F.call_function("shiftright", x, F.greatest(size - 11, F.lit(0)))).cast("int")


def hash_cut(hashes: DataFrame, md5: str, n: int) -> DataFrame:
    """One row: the lowest bin such that bins up to it hold at least ``n`` of the hashes, or the last
    bin if there are fewer. The bins are some 60,000 counts, whatever the number of rows."""
    return bin_cut(hashes.select(hash_bin(md5).alias("_b")), n)


def bin_cut(binned: DataFrame, n: int) -> DataFrame:
    """:func:`hash_cut` over a column ``_b`` of bins."""
    bins = binned.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    return bins.withColumn("_upto", F.sum("_n").over(upto)).agg(
        F.coalesce(F.min(F.when(F.col("_upto") >= n, F.col("_b"))), F.max("_b")).alias("_cut"))
