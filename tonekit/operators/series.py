"""Time series over aggregated periods: weekly battery, centred rolling baselines,
spike scores, greedy peak picking, moving means, running shares (C8, C9, F3-F8, F20, F21).

Rolling windows run on the aggregated series (one row per period and series key),
partitioned by the series key, so the per-message table is never windowed.  A
series is bounded by its span (52 rows a year), which is what lets the greedy peak
pick fold a whole series inside one row.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import calendar as cal


def _w(by: Sequence[str], order: str, lo: int, hi: int):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(lo, hi)


def weekly_series(df: DataFrame, ts: str = "ts", score: str = "anger", group: str = "party",
                  groups=K.MAIN_GROUPS, extra_means: Sequence[str] = (), by: Sequence[str] = (),
                  min_n: int = K.MIN_N_WEEK, period: str = "week") -> DataFrame:
    """Per week (Monday, UTC): n, mean, share over the threshold, the mean and
    count of each of two groups, extra means; weeks under ``min_n`` are dropped BEFORE
    any rolling window, so windows count surviving weeks."""
    key = cal.week_start(ts) if period == "week" else cal.month_start(ts)
    tags = ["dem", "rep"]
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(score).alias(score),
            F.avg((F.col(score) > K.ANGRY_THRESHOLD).cast("int")).alias("share_angry")]
    aggs += [F.avg(F.when(F.col(group) == g, F.col(score))).alias(f"{score}_{t}") for g, t in zip(groups, tags)]
    aggs += [F.sum((F.col(group) == g).cast("long")).alias(f"n_{t}") for g, t in zip(groups, tags)]
    aggs += [F.avg(c).alias(c) for c in extra_means]
    return df.groupBy(*by, key.alias("wk")).agg(*aggs).filter(F.col("n") >= min_n)


def rolling_median(x: str, by: Sequence[str] = (), order: str = "wk", width: int = K.BASELINE_WEEKS,
                   min_periods: int = K.BASELINE_MIN) -> Column:
    """centred rolling median over ``width`` rows (odd), NULL under ``min_periods``
    non-NULL values; NULLs are skipped as pandas does."""
    half = width // 2
    w = _w(by, order, -half, half)
    return F.when(F.count(x).over(w) >= min_periods, F.percentile(F.col(x), 0.5).over(w))


def rolling_std(x: str, by: Sequence[str] = (), order: str = "wk", width: int = K.RESID_WEEKS,
                min_periods: int = K.RESID_MIN) -> Column:
    """centred rolling sample stddev; an even width spans width/2 rows before and
    width/2 - 1 after, the pandas alignment."""
    w = _w(by, order, -(width // 2), width - 1 - width // 2)
    return F.when(F.count(x).over(w) >= min_periods, F.stddev_samp(x).over(w))


def baseline_and_spikes(series: DataFrame, score: str = "anger", by: Sequence[str] = (),
                        width: int = K.BASELINE_WEEKS, min_periods: int = K.BASELINE_MIN,
                        sd_width: int = K.RESID_WEEKS, sd_min: int = K.RESID_MIN,
                        group_scores: Sequence[str] = ("anger_dem", "anger_rep")) -> DataFrame:
    """Baseline (rolling median), excess, spike score (excess / rolling sd of
    excess) and each group's own excess over its rolling median."""
    out = series.withColumn("baseline", rolling_median(score, by, width=width, min_periods=min_periods))
    out = out.withColumn("excess", F.col(score) - F.col("baseline"))
    out = out.withColumn("spike_score", F.try_divide(F.col("excess"), rolling_std("excess", by, width=sd_width, min_periods=sd_min)))
    for g in group_scores:
        tag = g.split("_")[-1]
        out = out.withColumn(f"{tag}_excess", F.col(g) - rolling_median(g, by, width=width, min_periods=min_periods))
    return out


def greedy_peaks(series: DataFrame, by: Sequence[str] = (), value: str = "excess", period: str = "wk",
                 k: int = K.TOP_SPIKES, min_gap_days: int = K.MIN_GAP_DAYS) -> DataFrame:
    """walk candidates by ``value`` descending (earlier period first on ties), keep
    one unless a kept peak lies fewer than ``min_gap_days`` away, stop after ``k``.

    Each series folds inside one row with ``aggregate`` over its sorted candidates;
    series are independent rows, so many run in parallel.  Returns the kept rows."""
    cands = series.filter(F.col(value).isNotNull())
    folded = cands.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct((-F.col(value)).alias("neg"), F.col(period).alias("p")))).alias("c"))
    empty = F.array().cast("array<date>")

    def step(acc, x):
        close = F.exists(acc, lambda a: F.abs(F.datediff(x["p"], a)) < min_gap_days)
        return F.when((F.size(acc) < k) & ~close, F.concat(acc, F.array(x["p"]))).otherwise(acc)

    kept = folded.select(*by, F.explode(F.aggregate("c", empty, step)).alias(period))
    return series.join(kept, [*by, period], "left_semi")


def window_offsets(peaks: DataFrame, period: str = "wk", before: int = K.WINDOW_WEEKS_BEFORE,
                   after: int = K.WINDOW_WEEKS_AFTER, step_days: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """Each peak expanded to the periods from ``-before`` to ``+after`` steps
    around it, with an ``in_peak`` flag (a range join made an equi-join: the peak list
    is bounded by ``k``, so this table has at most ``k * (before + after + 1)`` rows)."""
    offs = F.sequence(F.lit(-before), F.lit(after))
    return peaks.select(*by, F.col(period).alias("peak"), F.explode(offs).alias("_o")).select(
        *by, "peak", F.date_add("peak", (F.col("_o") * step_days).cast("int")).alias(period),
        (F.col("_o") == 0).alias("in_peak"))


def moving_mean(x: str, by: Sequence[str] = (), order: str = "x", half: int = 2) -> Column:
    """centred moving mean over +-``half`` rows, truncated at the ends."""
    return F.avg(x).over(_w(by, order, -half, half))


def running_totals(df: DataFrame, by: Sequence[str], flag: str, ts: str = "ts", tie: str = "msg_id",
                   bucket: str = "month") -> DataFrame:
    """per ``by`` key, in time order, the running count of rows, of flagged rows
    and the running share.

    A plain ``OVER (PARTITION BY author ORDER BY ts)`` sorts an author's whole history
    in one task; a hot author would stall the job.  Instead the prefix sum is
    segmented: running sums inside (key, time bucket) partitions, plus an offset per
    bucket from the small table of bucket totals (keys x buckets rows)."""
    b = F.date_trunc(bucket, F.col(ts)).alias("_b")
    d = df.withColumn("_b", b)
    inner = Window.partitionBy(*by, "_b").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_ln", F.count(F.lit(1)).over(inner)).withColumn("_lf", F.sum(flag).over(inner))
    totals = d.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_tn"), F.sum(flag).alias("_tf"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_b", F.coalesce(F.sum("_tn").over(before), F.lit(0)).alias("_on"),
                            F.coalesce(F.sum("_tf").over(before), F.lit(0)).alias("_of"))
    out = d.join(offsets, [*by, "_b"])
    return (out.withColumn("running_n", F.col("_on") + F.col("_ln"))
               .withColumn("running_flagged", F.col("_of") + F.col("_lf"))
               .withColumn("running_share", F.col("running_flagged") / F.col("running_n"))
               .drop("_b", "_ln", "_lf", "_on", "_of"))


def scale_by_max(x: str, by: Sequence[str] = ()) -> Column:
    """divide by the largest absolute value of the (aggregated) series."""
    return F.try_divide(F.col(x), F.max(F.abs(x)).over(Window.partitionBy(*by)))


def upper_band(x: str = "anger", base: str = "baseline") -> Column:
    """Elementwise max of the series and its baseline (the shaded excess band)."""
    return F.greatest(F.col(x), F.col(base))
