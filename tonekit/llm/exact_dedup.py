"""Exact deduplication by progressive refinement; DataFrame functions only.

Rows are told apart by the cheapest sign first: length of the normalised text, then a hash
of its first characters, then a hash of all of it. Full hashes are taken only of texts that
still share length and prefix hash with another text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, bit_table, marked, settled, text_key

#: Characters of a text that the prefix hash covers.
PREFIX = 256


def normalised(text: str = "text") -> Column:
    """Null as empty; each run of blank, tab, line feed, VT, FF or CR becomes one blank."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sha, keep_id, group_size) of every text that more than one row has.

    1. rows are counted by length and prefix hash, and the counts written (a few bytes each);
    2. lengths that one row alone has go, then (length, prefix hash) pairs that one row has;
    3. what is left is marked in a bit table of bounded size, which is broadcast; the second
       scan hashes whole texts only where the bit is set. A false mark costs a hash and
       nothing else, as the groups are formed by the full hash.

    Every aggregate combines before its shuffle, so a group with a third of all rows is one
    row a task. ``keep_id`` is the smallest non-null id (null if the group has none).
    """
    base = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("t"))
    signed = base.select("id", "t", F.length("t").alias("n"), F.xxhash64(F.substring("t", 1, PREFIX)).alias("ph"))
    signs = settled(signed.select("n", "ph").groupBy("n", "ph").agg(F.count("*").alias("c")), "signs")
    lengths = signs.groupBy("n").agg(F.sum("c").alias("rows")).filter("rows > 1").select("n")
    pairs = settled(signs.filter("c > 1").join(lengths, "n", "left_semi"), "pairs")
    left = marked(signed, bit_table(pairs, ["n", "ph"]), ["n", "ph"]).filter("_maybe")
    return (left.select("id", F.sha2("t", 256).alias("sha")).groupBy("sha")
            .agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when equal after normalisation; null counts as empty, so null, empty and
    blank-only texts follow the same rule (blank-only: one blank). The smallest id of a group
    stays. Null ids lose to any id; rows that repeat both id and text are all ``kept`` (an id
    names them together); a group of null ids alone is kept. An empty table gives no rows.
    Only the id and text columns are read, so other columns can have any name.
    """
    groups = settled(exact_groups(docs, id_col, text_col), "groups")
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(normalised(text_col), 256).alias("sha"),
                       text_key(text_col).alias("th"))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return rows.join(groups, "sha", "left").select(
        F.col("id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256"), F.col("th").alias("text_key"))


def dropped(docs: DataFrame) -> DataFrame:
    """(did, th) of the rows that exact deduplication drops."""
    return exact_dedup(docs).filter("not kept").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.col("text_key").alias("th"))
