"""Export-shaped queries: pivots, per-year curves, hour profiles, interpolation, JSON."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import battery as B
from ..operators import export as X
from ..session import checkpoint_dir
from . import oracle_views as O
from .registry import register
from .series_queries import _MONTH_CELLS, _month_cells
from .views import analysis_posts, local_msgs


@register("pivot_dev", O.with_views(f"""
, c AS ({_MONTH_CELLS})
SELECT m.month, list(y.year ORDER BY y.year) AS years, list(ROUND(c.anger_dev, 6) ORDER BY y.year) AS dev
FROM (SELECT DISTINCT month FROM c) m, (SELECT DISTINCT year FROM c) y LEFT JOIN c ON c.month = m.month AND c.year = y.year
GROUP BY m.month""", d=O.D_POSTS).replace(")\n\n, c AS", "),\nc AS"))
def pivot_dev(spark, root):
    """Month x year deviations, long -> wide, one column for every year there is; here the
    columns stand in one array beside their years, as a statement cannot name them beforehand."""
    wide = X.pivot_wide(_month_cells(spark, root), "month", "year", "anger_dev")
    years = wide.columns[1:]
    return wide.select("month", F.array(*[F.lit(int(y)) for y in years]).alias("years"),
                       F.array(*[F.col(f"`{y}`") for y in years]).alias("dev"))


@register("year_curves", O.with_views(f"""SELECT year, list(month ORDER BY month) AS x, list(ROUND(anger_dev, 6) ORDER BY month) AS dev
FROM ({_MONTH_CELLS}) c GROUP BY year""", d=O.D_POSTS))
def year_curves(spark, root):
    """Per year, the deviation curve as parallel arrays ordered by month."""
    return X.parallel_arrays(_month_cells(spark, root), ["month"], ["month", "anger_dev"], group=["year"]).select(
        "year", F.col("month").alias("x"), F.col("anger_dev").alias("dev"))


@register("aligned_curves", O.with_views(f"""
, c AS ({_MONTH_CELLS}),
mean AS (SELECT month, sum(anger_dev * n) / sum(n) AS v FROM c GROUP BY month),
ys AS (SELECT DISTINCT year FROM c UNION ALL SELECT NULL)
SELECT ys.year, list(s.m ORDER BY s.m) AS x,
       list(ROUND(CASE WHEN ys.year IS NULL THEN mean.v ELSE c.anger_dev END, 6) ORDER BY s.m) AS dev
FROM ys, (SELECT unnest(range(1, 13)) AS m) s LEFT JOIN c ON c.year = ys.year AND c.month = s.m
LEFT JOIN mean ON mean.month = s.m GROUP BY ys.year""", d=O.D_POSTS).replace(")\n\n, c AS", "),\nc AS"))
def aligned_curves(spark, root):
    """Every year's curve over the full month spine (NULL where a cell is missing)
    and, with a NULL year, the n-weighted mean curve over years."""
    cells = _month_cells(spark, root)
    mean = cells.groupBy("month").agg((F.sum(F.col("anger_dev") * F.col("n")) / F.sum("n")).alias("anger_dev"))
    rows = cells.select("year", "month", "anger_dev").unionByName(
        mean.select(F.lit(None).cast("int").alias("year"), "month", "anger_dev"))
    per = rows.groupBy("year").agg(F.map_from_entries(F.collect_list(F.struct("month", "anger_dev"))).alias("_m"))
    spine = F.sequence(F.lit(1), F.lit(12))  # twelve entries a year
    return per.select("year", spine.alias("x"), F.transform(spine, lambda m: F.try_element_at("_m", m)).alias("dev"))


_HOURS = "range(0, 24)"


@register("hour_profile", O.with_views(f"""SELECT author,
       list((SELECT ROUND(avg(angry), 6) FROM m m2 WHERE m2.author = a.author AND m2.hour_local = h) ORDER BY h) AS share,
       list((SELECT count(*) FROM m m2 WHERE m2.author = a.author AND m2.hour_local = h) ORDER BY h) AS n,
       (SELECT count(*) FROM m m2 WHERE m2.author = a.author) AS total
FROM (SELECT DISTINCT author FROM m) a, (SELECT unnest({_HOURS}) AS h) hh GROUP BY author""",
                                       m=f"SELECT *, CAST(anger > 0.5 AS INTEGER) AS angry FROM ({O.MSGS_LOCAL}) q"))
def hour_profile(spark, root):
    """Per author, 24-slot arrays of angry share and message count by local hour."""
    d = local_msgs(spark, root).withColumn("angry", (F.col("anger") > K.ANGRY_THRESHOLD).cast("int"))
    return X.hour_profiles(d, "author", "hour_local", "angry")


@register("hour_interp", O.with_views(f"""SELECT t, ROUND(v0 + (v1 - v0) * f, 6) AS v FROM (
  SELECT tg.t, s0.v AS v0, s1.v AS v1, tg.f FROM (
    SELECT t, CAST(floor(p) AS INTEGER) AS i, p - floor(p) AS f, (CAST(floor(p) AS INTEGER) + 1) % 24 AS j FROM (
      SELECT r / 4.0 AS t, ((r / 4.0 - 0.5) % 24 + 24) % 24 AS p FROM range(0, 96) g(r)) q) tg
  JOIN s s0 ON s0.h = tg.i JOIN s s1 ON s1.h = tg.j) z""",
                                       s=f"""SELECT hour_local AS h, avg(CAST(anger > 0.5 AS INTEGER)) AS v FROM ({O.MSGS_LOCAL}) q
GROUP BY hour_local"""))
def hour_interp(spark, root):
    """The all-author hourly angry share at quarter hours, circular interpolation
    between bins centred on h + 0.5."""
    d = local_msgs(spark, root).withColumn("angry", (F.col("anger") > K.ANGRY_THRESHOLD).cast("int"))
    series = d.groupBy(F.col("hour_local").alias("h")).agg(F.avg("angry").alias("v"))
    targets = spark.range(96).select((F.col("id") / 4.0).alias("t"))
    return X.circular_lerp(series, targets)


_JSON_COLS = ["anger", "share_angry", "negative", "disgust", "joy", "optimism", "fear", "sadness", "anger_se"]


@register("year_json", O.with_views("SELECT list(year ORDER BY year) AS year, list(n ORDER BY year) AS n, " + ", ".join(
    f"list(ROUND({c}, 4) ORDER BY year) AS {c}" for c in _JSON_COLS) + f""" FROM (
  SELECT year, count(*) AS n, {", ".join(f"avg({c}) AS {c}" for c in _JSON_COLS if c not in ("share_angry", "anger_se"))},
         count(*) FILTER (anger > 0.5) / count(*) AS share_angry, stddev_samp(anger) / sqrt(count(*)) AS anger_se
  FROM d GROUP BY year HAVING count(*) >= 30) x""", d=O.D_POSTS))
def year_json(spark, root):
    """The yearly battery as one compact JSON document of parallel arrays (floats to 4 dp,
    NaN -> null), written and read again."""
    cells = X.rounded_for_export(B.mean_battery(analysis_posts(spark, root), ["year"], min_n=30))
    path = os.path.join(checkpoint_dir(spark), f"year-{uuid.uuid4().hex}")
    X.json_document(cells).write.text(path)
    return spark.read.schema(X.parallel_arrays(cells, ["year"], cells.columns).schema).json(path)


@register("party_json", O.with_views("SELECT party, list(year ORDER BY year) AS year, list(n ORDER BY year) AS n, " + ", ".join(
    f"list(ROUND({c}, 4) ORDER BY year) AS {c}" for c in ("anger", "joy")) + """ FROM (
  SELECT party, year, count(*) AS n, avg(anger) AS anger, avg(joy) AS joy FROM d GROUP BY party, year HAVING count(*) >= 30) x
GROUP BY party""", d=O.D_POSTS))
def party_json(spark, root):
    """One JSON document with a dictionary entry for each party, its yearly curve as parallel
    arrays; written, read again as a map and spread to rows."""
    cells = B.mean_battery(analysis_posts(spark, root), ["party", "year"], means=("anger", "joy"), min_n=30)
    cols = ["year", "n", "anger", "joy"]
    path = os.path.join(checkpoint_dir(spark), f"party-{uuid.uuid4().hex}")
    X.json_dictionary(X.rounded_for_export(cells.select("party", *cols)), "party", ["year"], cols).write.text(path)
    doc = spark.read.text(path).select(F.from_json(
        "value", "map<string, struct<year: array<int>, n: array<bigint>, anger: array<double>, joy: array<double>>>").alias("d"))
    return doc.select(F.explode("d").alias("party", "v")).select("party", "v.*")


@register("chamber_hours", O.with_views(f"""SELECT list(ROUND(s, 6) ORDER BY h) AS share, list(n ORDER BY h) AS n,
       CAST(sum(n) AS BIGINT) AS total FROM (
  SELECT hh.h, (SELECT avg(angry) FROM m WHERE m.hour_local = hh.h) AS s,
         (SELECT count(*) FROM m WHERE m.hour_local = hh.h) AS n FROM (SELECT unnest({_HOURS}) AS h) hh) x""",
                                         m=f"SELECT *, CAST(anger > 0.5 AS INTEGER) AS angry FROM ({O.MSGS_LOCAL}) q"))
def chamber_hours(spark, root):
    """The all-author 24-slot hourly share and counts (the chamber line of the
    time-lapse), from the 24-row hourly aggregate."""
    d = local_msgs(spark, root).withColumn("angry", (F.col("anger") > K.ANGRY_THRESHOLD).cast("int"))
    prof = X.hour_profiles(d.withColumn("_all", F.lit(1)), "_all", "hour_local", "angry")
    return prof.select("share", "n", "total")
