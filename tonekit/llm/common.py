"""Helpers shared by the operators: settled tables, row keys, sorted streams, components."""
from __future__ import annotations

import os
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import bin_cut, log_bin
from ..session import checkpoint_dir

#: Stands for a null id where ids are ordered; null ids come first.
NULL_ID = -(1 << 63)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage (a lost executor costs a read, not a recomputation) and gives the
    planner the true size, so a later join broadcasts it only below Spark's threshold and
    shuffles it otherwise.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: str | Column) -> Column:
    """64-bit hash of a text; with the id it names a row where ids repeat or are null."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


#: Rows and bytes in an Arrow batch: texts and index shards are long, and Spark's defaults of
#: 10,000 rows and 64 MB, in the JVM and in the worker of each task, hold too many.
ARROW_ROWS = 1000
ARROW_BYTES = 4 << 20


def bounded_batches(docs: DataFrame) -> DataFrame:
    """``docs``, with the session's Arrow batches bounded to ARROW_ROWS rows and about ARROW_BYTES
    (one row at least), so that neither a Python worker nor the JVM beside it holds more than a
    few megabytes of texts at once. Settings of the session that are lower stay."""
    conf = docs.sparkSession.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ARROW_ROWS:
        conf.set(name, str(ARROW_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)([kmgtp]?)b?", conf.get(name).lower())  # "67108864b", "64m"
    if not now or not 0 < int(now[1]) << 10 * " kmgtp".index(now[2] or " ") <= ARROW_BYTES:
        conf.set(name, str(ARROW_BYTES))
    return docs


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, th, text) of each row: id with null as NULL_ID, text hash, text with null as empty.

    Only the two named columns are read, so other columns can have any name.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return bounded_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("did"),
                       text_key(text).alias("th"), text.alias("text"))


def real_id(col: str | Column = "did") -> Column:
    """The id as the caller knows it: NULL_ID becomes null again."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c != F.lit(NULL_ID), c)


#: A bit table has 16 bits a key, and 2**LEAST_BITS to 2**MOST_BITS bits: 2**(MOST_BITS - 6) rows of 16 bytes,
#: 32 megabytes, at most. Beyond some hundred million keys every row is marked and the saving is gone.
LEAST_BITS, MOST_BITS = 20, 27


def _slot(cols: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << bits))


@dataclass(frozen=True)
class Bits:
    table: DataFrame
    bits: int


def bit_table(keys: DataFrame, cols: list[str]) -> Bits:
    """Marks of the keys in a table of bounded size, whatever their number. ``keys`` are counted first, so
    they should be a written table."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * keys.count()).bit_length()))
    slots = keys.select(_slot(cols, bits).alias("slot"))
    return Bits(settled(slots.groupBy(F.shiftright("slot", 6).alias("_word"))
                        .agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("_bits")), "bits"), bits)


def marked(rows: DataFrame, table: Bits, cols: list[str]) -> DataFrame:
    """``rows`` with ``_maybe``: false only if the row's key is not in the table. The table is
    broadcast, its size is bounded; a false mark costs the caller work, never a wrong result."""
    out = rows.withColumn("_slot", _slot(cols, table.bits)).withColumn("_word", F.shiftright("_slot", 6))
    out = out.join(F.broadcast(table.table), "_word", "left")
    bit = F.expr("(shiftrightunsigned(_bits, cast(_slot % 64 as int)) & 1L) = 1L")
    return out.withColumn("_maybe", F.coalesce(bit, F.lit(False))).drop("_slot", "_word", "_bits")


def lowest(rows: DataFrame, order: Column, n: int) -> DataFrame:
    """The rows among which the ``n`` of smallest ``order`` (a 64-bit hash) are, and hardly any others.

    A pass over the hashes counts them in bins that are narrow where hashes are low, so what is
    left to sort is about ``n`` rows, not ``n`` of every task."""
    h = F.shiftright(order, 1) + F.lit(1 << 62)  # in the same order from 0 up
    cut = bin_cut(rows.select(log_bin(h).alias("_b")), n)
    return rows.filter(log_bin(h) <= cut.scalar())


def without(docs: DataFrame, drop: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose (id, text hash) is not in ``drop`` (did, th); all columns stay.

    The rows travel as one struct, so no column name of ``docs`` can clash. Rows that the bit
    table of ``drop`` doesn't mark stay where they are; only marked ones meet ``drop`` itself.
    """
    drop = settled(drop.select(F.col("did").alias("_did"), F.col("th").alias("_th")).distinct(), "drop")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_did"),
                       text_key(text_col).alias("_th"))
    parted = marked(rows, bit_table(drop, ["_did", "_th"]), ["_did", "_th"])
    kept = parted.filter("_maybe").join(drop, ["_did", "_th"], "left_anti")
    return parted.filter("not _maybe").select("_row.*").unionByName(kept.select("_row.*"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of those that repeat id and text, whatever their other columns (the one of
    smallest hash over all columns stays). Only rows whose key repeats are shuffled, and those are
    combined in each task first."""
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_did"), text_key(text_col).alias("_th")]
    again = settled(docs.select(*key).groupBy("_did", "_th").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "again")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *key)
    parted = marked(rows, bit_table(again, ["_did", "_th"]), ["_did", "_th"])
    some = parted.filter("_maybe").drop("_maybe")
    one = some.join(again, ["_did", "_th"], "left_semi").groupBy("_did", "_th").agg(
        F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return (parted.filter("not _maybe").select("_row.*")
            .unionByName(some.join(again, ["_did", "_th"], "left_anti").select("_row.*")).unionByName(one.select("_row.*")))


def sized_batches(batches, limit: int, column: str = "text"):
    """Cut Arrow batches so that each holds about ``limit`` bytes of ``column`` (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # workers live on and serve other stages


def ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def later_copies(rows: DataFrame, keys: list[str], place: list[str], always: str | None = None) -> DataFrame:
    """The rows that have an equal ``keys`` row at a smaller ``place``; the first of each key goes.
    Rows with a true ``always`` stay and are nobody's first; they are dealt out by their own keys.

    Rows at the same place as the first count as the first. One shuffle by the first key, a
    sort that may spill, and a pass that remembers one row: a key with any number of rows
    needs no memory. Callers send one row of a frequent key per batch, not one per occurrence.
    """
    cols = rows.columns

    def scan(batches):
        last = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            k = [ints(batch, c) for c in keys]
            p = [ints(batch, c) for c in place]
            n = batch.num_rows
            if always:
                stay = ints(batch, always)
                here, batch = batch.filter(pa.array(stay)), batch.filter(pa.array(~stay))
                yield here
                if batch.num_rows == 0:
                    continue
                k, p = [x[~stay] for x in k], [x[~stay] for x in p]
                n = batch.num_rows
            new = np.zeros(n, bool)
            for x in k:
                new[1:] |= x[1:] != x[:-1]
            new[0] = last is None or any(x[0] != y for x, y in zip(k, last[0]))
            # place of the first row of each run, carried over from the batch before
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            same = np.ones(n, bool)
            for j, x in enumerate(p):
                first = np.where(start >= 0, x[np.maximum(start, 0)], last[1][j] if last else 0)
                same &= x == first
            last = ([x[-1] for x in k],
                    [x[start[-1]] if start[-1] >= 0 else last[1][j] for j, x in enumerate(p)])
            yield batch.filter(pa.array(~same))

    dealt = rows.repartition(keys[0]).sortWithinPartitions(*keys, *place)
    return dealt.mapInArrow(scan, rows.schema).select(*cols)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected graph ``edges`` (a, b); root is the
    smallest node of its component.

    Alternating large-star and small-star rounds: each joins the edges with one row per node
    (its smallest neighbour), so no neighbour list is ever gathered, and edges only fall in
    number. Every round is written to the shared folder. Rounds grow with the logarithm of
    the longest path.
    """
    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    e = settled(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .distinct(), "edges")
    mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.filter("v > u").join(least(both).select("u", F.least("m", "u").alias("m")), "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        large = settled(large, "edges")
        small = large.join(least(large), "u")
        e = settled(small.select("u", F.col("m").alias("v"))
                    .unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
                    .distinct(), "edges")
        was, mark = mark, e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
