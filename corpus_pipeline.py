"""The corpus pipeline: documents that pass quality, deduplication and decontamination, as tokens.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``. Rows are named by id and text hash, so null and repeated ids,
null and empty texts and columns of any name pass through; rows that repeat id and text share
one decision, and the exact stage keeps one of them. An empty table gives an empty table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonekit.llm import bpe, decontam, exact_dedup, quality, simhash
from tonekit.llm.common import NULL_ID, one_of_each, settled, table, without


def _rows(decided: DataFrame) -> DataFrame:
    """(did, th) of rows of an operator's result."""
    return decided.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"),
                          F.col("text_key").alias("th"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return without(docs, _rows(quality.assess(docs, table(spark, sf_dir, "labels")).filter("not keep")))


def _all_but_one(kept: DataFrame, group: str) -> DataFrame:
    """Of rows that an operator keeps together in one group (they share the group's id, or have none),
    all but the one of smallest text hash."""
    several = kept.groupBy(F.col(group).alias("_g")).agg(F.min("text_key").alias("_least"), F.max("text_key").alias("_most"))
    several = several.filter("_least <> _most")
    return kept.join(several, kept[group].eqNullSafe(several["_g"])).filter("text_key <> _least")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays; among rows that share that id, or have
    none, the one of smallest text hash, and of rows that repeat id and text one."""
    found = settled(exact_dedup.exact_dedup(docs).filter("group_size > 1"), "groups")
    drop = found.filter("not kept").unionByName(_all_but_one(found.filter("kept"), "text_sha256").select(found.columns))
    return one_of_each(without(docs, _rows(drop)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the document with the smallest id stays; among rows that share
    that id the one of smallest text hash. A component of null ids alone keeps its rows."""
    found = simhash.near_duplicates(docs)
    kept = found.filter("doc_id = component_id")
    drop = found.filter("not (doc_id <=> component_id)").select("doc_id", "text_key").unionByName(
        _all_but_one(kept, "component_id").select("doc_id", "text_key"))
    return without(docs, _rows(drop))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return without(docs, _rows(decontam.contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left: doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe.encode(docs)


STAGES = [("quality_classifier", quality_stage), ("exact_dedup", exact_dedup_stage),
          ("simhash_near_dedup", near_dedup_stage), ("benchmark_decontamination", decontaminate_stage),
          ("byte_bpe", encode_stage)]

#: The quality model and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name)
    return docs
