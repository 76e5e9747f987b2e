"""Per-group regressions with cluster-robust errors, fixed effects, rank statistics
(F9, F10, F15-F17, E14-E16, D6, D7).

The regressions are closed forms over grouped sums, so they run as ordinary
aggregations however many rows a group holds:

    x~, y~   centred (F15), centred within a category (F16) or weighted-centred within
             the fixed-effect unit (F17) -- Frisch-Waugh-Lovell removes the dummies
    b        = sum w x~ y~ / sum w x~^2
    s_c      = sum over cluster c of w x~ (y~ - b x~) = A_c - b B_c
    var(b)   = G/(G-1) * (N-1)/(N-K) * sum_c s_c^2 / (sum w x~^2)^2

with N rows, G clusters and K parameters of the full dummy model (the small-sample
factor is the usual one of cluster-robust OLS software).  The rows are read once, into
the weight, means and centred co-moments of each (group, category, cluster); A_c and B_c
follow from those by the rule for merging two centred sums, so no join ever meets the rows
and an x far from zero (a year, a time stamp) costs no digits.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(x) -> list[str]:
    return [] if x is None else ([x] if isinstance(x, str) else list(x))


def clustered_slope(df: DataFrame, group: str | Sequence[str] | None, y: str, x: str, cluster: str,
                    absorb: str | None = None, weight: str | None = None, min_rows: int = 0,
                    scale: float = 1.0) -> DataFrame:
    """Per ``group`` (or over all rows when ``group`` is empty), the OLS
    -- or WLS with ``weight`` -- slope of ``y`` on ``x`` with standard error clustered
    by ``cluster``.

    ``absorb`` names a categorical regressor (F16) or fixed-effect unit (F17) whose
    dummies are partialled out by centring within it.  Returns group, n, clusters,
    slope, se, z (slope and se times ``scale``).  Rows with NULL y, x, cluster, absorb
    or weight are dropped; groups under ``min_rows`` rows are skipped.

    One aggregate of the rows gives the co-moments per (group, absorb, cluster): Spark's own
    variance and covariance, which tasks merge pairwise, or with weights sums of values less
    their mean; centring and the cluster sums A_c, B_c are arithmetic on them."""
    g = _cols(group)
    centre_keys = g + _cols(absorb)
    if not centre_keys:
        raise ValueError("clustered_slope needs a group or an absorbed category to centre within")
    need = [y, x, cluster] + _cols(absorb) + _cols(weight)
    d = df.select(*g, *need).dropna(subset=need)
    cells = _comoments(d, list(dict.fromkeys([*centre_keys, cluster])), y, x, weight)
    means = cells.groupBy(*centre_keys).agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_mx"),
                                            (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("_my"))
    c = cells.join(means, centre_keys)
    dx, dy = F.col("_x") - F.col("_mx"), F.col("_y") - F.col("_my")
    per_cluster = c.groupBy(*g, cluster).agg(
        F.sum(F.col("_xy") + F.col("_w") * dx * dy).alias("_a"), F.sum(F.col("_xx") + F.col("_w") * dx * dx).alias("_b"),
        F.sum("_rows").alias("_rows"))
    a, b = F.col("_a"), F.col("_b")
    tot = per_cluster.groupBy(*g).agg(
        F.sum("_rows").alias("n"), F.count(F.lit(1)).alias("clusters"), F.sum(a).alias("_sxy"),
        F.sum(b).alias("_sxx"), F.sum(a * a).alias("_saa"), F.sum(a * b).alias("_sab"), F.sum(b * b).alias("_sbb"))
    if absorb and absorb != cluster:
        cats = means.groupBy(*g).agg(F.count(F.lit(1)).alias("_cats"))  # categories present per group
        tot = tot.join(cats, g)
        k = F.col("_cats") + 1          # intercept + (C - 1) dummies + slope
    elif absorb:
        k = F.col("clusters") + 1       # one effect per unit (absorbs the intercept) + slope
    else:
        k = F.lit(2)
    tot = tot.filter(F.col("n") >= min_rows).withColumn("_slope", F.try_divide(F.col("_sxy"), F.col("_sxx")))
    slope = F.col("_slope")
    meat = F.greatest(F.col("_saa") - 2 * slope * F.col("_sab") + slope * slope * F.col("_sbb"), F.lit(0.0))
    nn, gg = F.col("n"), F.col("clusters")
    factor = F.try_divide(gg, gg - 1) * F.try_divide(nn - 1, nn - k)
    se = F.sqrt(F.try_divide(factor * meat, F.col("_sxx") * F.col("_sxx")))
    return tot.select(*g, "n", "clusters", (slope * scale).alias("slope"), (se * scale).alias("se"),
                      F.try_divide(slope, se).alias("z"))


def _comoments(d: DataFrame, keys: list[str], y: str, x: str, weight: str | None) -> DataFrame:
    """keys, _w (weight), _x and _y (means), _xx and _xy (centred sums of squares and products), _rows."""
    xs, ys, rows = F.col(x).cast("double"), F.col(y).cast("double"), F.count(F.lit(1))
    if not weight:
        return d.groupBy(*keys).agg(
            rows.cast("double").alias("_w"), F.avg(xs).alias("_x"), F.avg(ys).alias("_y"), (F.var_pop(xs) * rows).alias("_xx"),
            (F.covar_pop(xs, ys) * rows).alias("_xy"), rows.alias("_rows"))
    x0, y0 = (F.coalesce(d.agg(F.avg(c)).scalar(), F.lit(0.0)) for c in (xs, ys))  # any point near the values will do
    w = F.col(weight).cast("double")
    near = d.withColumn("_x0", x0).withColumn("_y0", y0).withColumn("_dx", xs - F.col("_x0")).withColumn("_dy", ys - F.col("_y0"))
    s = near.groupBy(*keys).agg(
        F.sum(w).alias("_w"), F.sum(w * F.col("_dx")).alias("_sx"), F.sum(w * F.col("_dy")).alias("_sy"),
        F.sum(w * F.col("_dx") * F.col("_dx")).alias("_sxx"), F.sum(w * F.col("_dx") * F.col("_dy")).alias("_sxy"),
        F.first("_x0").alias("_x0"), F.first("_y0").alias("_y0"), rows.alias("_rows"))
    mx, my = F.try_divide("_sx", "_w"), F.try_divide("_sy", "_w")
    return s.select(*keys, "_w", (F.col("_x0") + mx).alias("_x"), (F.col("_y0") + my).alias("_y"),
                    (F.col("_sxx") - F.col("_sx") * mx).alias("_xx"), (F.col("_sxy") - F.col("_sx") * my).alias("_xy"), "_rows")


def normal_p(z: str | Column) -> Column:
    """Two-sided normal p-value ``erfc(|z| / sqrt 2)`` from built-in functions.

    Below 2 by the all-positive series of erf, from 2 on by the continued fraction of erfc
    (evaluated from its tail), which keeps its relative precision however small p is."""
    x = F.abs(F.col(z) if isinstance(z, str) else z) / F.lit(math.sqrt(2.0))
    bell = F.exp(-x * x)
    term = F.aggregate(F.sequence(F.lit(1), F.lit(60)),
                       F.struct(x.alias("t"), x.alias("s")),
                       lambda a, k: F.struct((a["t"] * 2 * x * x / (2 * k + 1)).alias("t"),
                                             (a["s"] + a["t"] * 2 * x * x / (2 * k + 1)).alias("s")))
    near = F.lit(1.0) - F.lit(2 / math.sqrt(math.pi)) * bell * term["s"]
    tail = F.aggregate(F.sequence(F.lit(80), F.lit(1)), F.lit(0.0), lambda a, k: k / 2.0 / (x + a))
    far = bell / F.lit(math.sqrt(math.pi)) / (x + tail)
    return F.when(x < 2.0, near).when(x >= 2.0, far)


def with_p(df: DataFrame, z: str = "z", out: str = "p") -> DataFrame:
    return df.withColumn(out, normal_p(z))


def panel_cells(df: DataFrame, unit: str, period: str, y: str, x: str, min_n: int,
                extra: Sequence[Column] = ()) -> DataFrame:
    """E14/D6/F17 input: per (unit, period) cell, the mean of ``y`` minus the period
    mean over all rows, the mean of ``x`` and the row count; cells under ``min_n`` dropped
    (after the period mean, which covers every row).

    The mean of ``y`` less the period mean is the mean of the differences, so the period
    means are taken from the cells and meet them, not the rows."""
    cells = df.groupBy(unit, period).agg(F.sum(y).alias("_sy"), F.count(y).alias("_ny"), F.avg(x).alias(x),
                                         F.count(F.lit(1)).alias("n"), *extra)
    pm = cells.groupBy(period).agg((F.sum("_sy") / F.sum("_ny")).alias("_pm"))
    out = cells.join(pm, period).withColumn(f"{y}_dev", F.try_divide(F.col("_sy"), F.col("_ny")) - F.col("_pm"))
    rest = [c for c in cells.columns if c not in (unit, period, "_sy", "_ny", x, "n")]
    return out.filter(F.col("n") >= min_n).select(unit, period, f"{y}_dev", x, "n", *rest)


def long_span_units(cells: DataFrame, unit: str, period: str, min_span: int = 5, min_count: int = 6) -> DataFrame:
    """Keep units whose periods span at least ``min_span`` and number at least
    ``min_count`` (a semi-join on the computed keep-list)."""
    keep = cells.groupBy(unit).agg(F.min(period).alias("_lo"), F.max(period).alias("_hi"),
                                   F.count(F.lit(1)).alias("_k"))
    keep = keep.filter((F.col("_hi") - F.col("_lo") >= min_span) & (F.col("_k") >= min_count))
    return cells.join(keep.select(unit), unit, "left_semi")


def within_unit_slope(cells: DataFrame, unit: str, y: str, x: str, weight: str = "n",
                      min_units: int = 20, scale: float = 10.0) -> DataFrame:
    """fixed-effects WLS of ``y`` on ``x`` with one effect per unit, weights
    ``weight``, errors clustered by unit; NULL estimates when fewer than ``min_units``."""
    res = with_p(clustered_slope(cells, None, y, x, unit, absorb=unit, weight=weight, scale=scale))
    enough = F.col("clusters") >= min_units
    return res.select(F.col("clusters").alias("members"), F.col("n").alias("member_years"),
                      F.when(enough, F.col("slope")).alias("slope_per_decade"),
                      *[F.when(enough, F.col(c)).alias(c) for c in ("se", "z", "p")])


def positions(df: DataFrame, x: str, buckets: int = 128) -> DataFrame:
    """Per distinct value of ``x``: its count ``c`` and the number of rows ``before`` it.

    Values are cut into ranges at approximate quantiles; running sums inside a range and an
    offset from the totals of the ranges (``buckets`` rows at most) replace one global sort."""
    some = df.filter(F.col(x).isNotNull())
    cuts = sorted(set(some.approxQuantile(x, [i / buckets for i in range(1, buckets)], 0.5 / buckets)))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(x))) if cuts else F.lit(0)
    counts = some.groupBy(x).agg(F.count(F.lit(1)).alias("c")).withColumn("_b", part)
    inner = Window.partitionBy("_b").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("_b").agg(F.sum("c").alias("_t"))
    offset = ranges.select("_b", F.coalesce(F.sum("_t").over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return (counts.withColumn("_in", F.coalesce(F.sum("c").over(inner), F.lit(0))).join(offset, "_b")
            .select(x, "c", (F.col("_o") + F.col("_in")).alias("before")))


def exact_median(df: DataFrame, x: str) -> DataFrame:
    """The interpolated median of ``x`` from :func:`positions` (one row)."""
    n = df.filter(F.col(x).isNotNull()).count()
    lo, hi = (n - 1) // 2, n // 2
    at = positions(df, x)

    def holds(k: int) -> Column:
        return (F.col("before") <= k) & (F.col("before") + F.col("c") > k)

    mid = [F.max(F.when(holds(k), F.col(x))) for k in (lo, hi)]
    return at.agg(((mid[0] + mid[1]) / 2).alias("median"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's rho = Pearson correlation of the average ranks (ties share the mean of
    their positions); rows with a NULL in either are left out."""
    d = df.select(a, b).dropna()

    def ranks(x: str, out: str) -> DataFrame:
        return positions(d, x).select(x, (F.col("before") + (F.col("c") + 1) / 2.0).alias(out))

    r = d.join(ranks(a, "_ra"), a).join(ranks(b, "_rb"), b)
    return r.agg(F.corr("_ra", "_rb").alias("rho"), F.count(F.lit(1)).alias("n"))
