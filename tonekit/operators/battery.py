"""Mean-score batteries and within-group deviation.

A battery is one ``groupBy().agg()``: every aggregate is algebraic (count, sum, avg,
stddev), so Spark aggregates partially before the shuffle and a hot key costs no
more than a cold one.  Deviation runs on the aggregated cells only.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def angry_flag(score: str = "anger", threshold: float = K.ANGRY_THRESHOLD) -> Column:
    """Strict threshold flag as 0/1 integer."""
    return (F.col(score) > F.lit(threshold)).cast("int")


def mean_battery(
    df: DataFrame,
    keys: Sequence[str],
    means: Sequence[str] = ("anger", "negative", "disgust", "joy", "optimism", "fear", "sadness"),
    share_of: str | None = "anger",
    share_name: str = "share_angry",
    threshold: float = K.ANGRY_THRESHOLD,
    se_of: str | None = "anger",
    min_n: int = K.MIN_N_TIME,
    where: Column | None = None,
    distinct_of: str | None = None,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Per key: ``n``, mean of each score, share over the threshold, standard error.

    Column order follows the published tables: keys, n, [members], first mean,
    share, remaining means, extras, ``<se_of>_se``.  ``HAVING n >= min_n``.  Not sorted: the
    consumers window or join the cells next, and sort last where they print them.
    """
    keys = _cols(keys)
    if where is not None:
        df = df.filter(where)
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    if distinct_of:
        aggs.append(F.count_distinct(distinct_of).alias("members"))
    for i, m in enumerate(means):
        aggs.append(F.avg(m).alias(m))
        if i == 0 and share_of:
            aggs.append(F.avg(angry_flag(share_of, threshold)).alias(share_name))
    aggs.extend(extra)
    if se_of:
        aggs.append((F.stddev_samp(se_of) / F.sqrt(F.count(F.lit(1)))).alias(f"{se_of}_se"))
    return df.groupBy(*keys).agg(*aggs).filter(F.col("n") >= min_n)


def deviation_within(cells: DataFrame, within: str | Sequence[str], col: str = "anger",
                     weight: str = "n", out: str | None = None) -> DataFrame:
    """``col`` minus the ``weight``-weighted mean of ``col`` over the surviving cells
    of the same ``within`` group.  Runs on an aggregated table; the window is keyed,
    so each group is one task and groups spread over the cluster."""
    w = Window.partitionBy(*_cols(within))
    base = F.sum(F.col(col) * F.col(weight)).over(w) / F.sum(weight).over(w)
    return cells.withColumn(out or f"{col}_dev", F.col(col) - base)


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str = "n", count: str = "cells") -> DataFrame:
    """``sum(x*w)/sum(w)`` per key (partial-aggregable) and the number of cells."""
    return df.groupBy(*_cols(keys)).agg(
        F.count(F.lit(1)).alias(count), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value))


def error_bar(se: str = "anger_se", z: float = 1.96) -> Column:
    """half-width of the 95 % interval."""
    return F.col(se) * F.lit(z)


def sign_consistency(cells: DataFrame, keys: Sequence[str], dev: str = "anger_dev") -> DataFrame:
    """in how many groups a deviation is above / below zero ("13 of 16 years")."""
    return cells.groupBy(*_cols(keys)).agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col(dev) > 0).alias("above"),
        F.count_if(F.col(dev) < 0).alias("below"),
    )


def argmax_per_group(cells: DataFrame, group: str | Sequence[str], by: str, keep: Sequence[str]) -> DataFrame:
    """F8: the row with the largest ``by`` in each group; ties go to the smallest
    ``keep`` values (first row in key order, as an idxmax over a sorted table)."""
    g = _cols(group)
    w = Window.partitionBy(*g).orderBy(F.col(by).desc(), *[F.col(k).asc() for k in keep])
    return (cells.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            .select(*g, *[k for k in keep if k not in g], by))
