"""Regression, panel, volume and rank-correlation queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import panel as P
from ..operators.rates import latest
from . import oracle_views as O
from .age_queries import AGE, age_view
from .registry import register
from .views import msgs

MIN_ROWS = 100       # per-year rows for a slope (1,000 on the full corpus)
CELL_MIN = 1         # author-year cell floor (MIN_N // 4 on the full corpus)
VOLUME_MIN = 30      # per-author floor for the volume table (2,000 on the full corpus)


def _slopes(spark, root):
    d = age_view(spark, root).filter(F.col("party").isNotNull()).select(
        "year", "anger", "age_at_tweet", "author", "party")
    raw = P.clustered_slope(d, "year", "anger", "age_at_tweet", "author", min_rows=MIN_ROWS, scale=10.0)
    adj = P.clustered_slope(d, "year", "anger", "age_at_tweet", "author", absorb="party", min_rows=MIN_ROWS, scale=10.0)
    both = raw.select("year", "n", F.col("clusters").alias("members"), F.col("slope").alias("slope_per_decade"),
                      "se", "z").join(
        adj.select("year", F.col("slope").alias("slope_per_decade_party_adj"), F.col("z").alias("z_party_adj")), "year")
    return P.with_p(P.with_p(both, "z", "p"), "z_party_adj", "p_party_adj")


def _p_sql(z: str) -> str:
    """Two-sided normal p by Simpson's rule over the density beyond |z| (12 standard
    deviations in 2,000 steps): independent of the series in ``panel.normal_p``."""
    return (f"list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i % 2000 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
            f"* exp(-pow(abs({z}) + i * 0.006, 2) / 2))) * 0.002 * sqrt(2 / pi())")


def _slope_sql(centre: str, kexpr: str, tag: str) -> str:
    return f"""
{tag}m AS (SELECT year, {centre}, avg(x) AS mx, avg(y) AS my FROM base GROUP BY year, {centre}),
{tag}pc AS (SELECT b.year, b.c, sum((x - mx) * (y - my)) AS a, sum((x - mx) * (x - mx)) AS bb
            FROM base b JOIN {tag}m USING (year, {centre}) GROUP BY 1, 2),
{tag}t AS (SELECT year, sum(a) / sum(bb) AS slope, sum(bb) AS sxx FROM {tag}pc GROUP BY year),
{tag}mt AS (SELECT p.year, sum((a - slope * bb) * (a - slope * bb)) AS meat FROM {tag}pc p JOIN {tag}t USING (year) GROUP BY 1),
{tag}r AS (SELECT s.year, slope, sqrt(s.clusters / (s.clusters - 1) * (s.n - 1) / (s.n - ({kexpr})) * meat / (sxx * sxx)) AS se
           FROM sizes s JOIN {tag}t USING (year) JOIN {tag}mt USING (year))"""


_OLS = O.with_views(f"""
, base AS (SELECT year, anger AS y, age_at_tweet AS x, author AS c, party, 1 AS one FROM a WHERE party IS NOT NULL),
sizes AS (SELECT year, count(*) AS n, count(DISTINCT c) AS clusters, count(DISTINCT party) AS cats FROM base GROUP BY year
          HAVING count(*) >= {MIN_ROWS}),""" + _slope_sql("one", "2", "raw") + "," + _slope_sql("party", "s.cats + 1", "adj") + """
SELECT s.year, s.n, s.clusters AS members, ROUND(10 * o.slope, 6) AS slope_per_decade, ROUND(10 * o.se, 6) AS se,
       ROUND(o.slope / o.se, 6) AS z, ROUND(10 * q.slope, 6) AS slope_per_decade_party_adj, ROUND(q.slope / q.se, 6) AS z_party_adj,
       ROUND(""" + _p_sql("(o.slope / o.se)") + ", 6) AS p, ROUND(" + _p_sql("(q.slope / q.se)") + """, 6) AS p_party_adj
FROM sizes s JOIN rawr o USING (year) JOIN adjr q USING (year)""", a=AGE).replace(")\n\n, base AS", "),\nbase AS")


@register("ols_by_year", _OLS)
def ols_by_year(spark, root):
    """Per year, OLS slope of score on age (x10 = per decade) with errors clustered
    by author and two-sided normal p; raw and adjusted for group (category partialled out)."""
    return _slopes(spark, root)


@register("ols_pvalues", f"SELECT year, z, p, z_party_adj, p_party_adj FROM ({_OLS}) x")
def ols_pvalues(spark, root):
    """The z and p of both slopes."""
    return _slopes(spark, root).select("year", "z", "p", "z_party_adj", "p_party_adj")


def _fe_cells(spark, root):
    d = age_view(spark, root)
    cells = P.panel_cells(d, "author", "year", "anger", "age_at_tweet", CELL_MIN,
                          extra=[F.min("party").alias("party")])  # E6: any value, made repeatable
    return P.long_span_units(cells, "author", "year")


# Oracle: year means and spans as window totals over the messages and the cells.
_CELLS = f"""
means AS (SELECT author, year, party, age_at_tweet, anger - avg(anger) OVER (PARTITION BY year) AS off FROM a),
cell AS (SELECT author, year, avg(off) AS anger_dev, avg(age_at_tweet) AS age_at_tweet, count(*) AS n, min(party) AS party
         FROM means GROUP BY author, year),
kept AS (SELECT * FROM cell WHERE n >= {CELL_MIN}
         QUALIFY max(year) OVER (PARTITION BY author) - min(year) OVER (PARTITION BY author) >= 5
             AND count(*) OVER (PARTITION BY author) >= 6)"""


def _fe(body: str) -> str:
    return O.with_views("", a=AGE).rstrip() + "," + _CELLS + "\n" + body


_FE = _fe(f"""
, dev AS (SELECT author, n, age_at_tweet - sum(n * age_at_tweet) OVER u / sum(n) OVER u AS x,
               anger_dev - sum(n * anger_dev) OVER u / sum(n) OVER u AS y
        FROM kept WINDOW u AS (PARTITION BY author)),
fit AS (SELECT *, sum(n * x * y) OVER () / sum(n * x * x) OVER () AS b, sum(n * x * x) OVER () AS sxx FROM dev),
scores AS (SELECT author, any_value(b) AS b, any_value(sxx) AS sxx, sum(n * x * (y - b * x)) AS s, count(*) AS cells
           FROM fit GROUP BY author),
done AS (SELECT count(*) AS g, CAST(sum(cells) AS BIGINT) AS rows, any_value(b) AS b,
              sqrt(count(*) / (count(*) - 1) * (sum(cells) - 1) / (sum(cells) - count(*) - 1) * sum(s * s)) / any_value(sxx) AS se
       FROM scores HAVING count(*) > 0)
SELECT g AS members, rows AS member_years, ROUND(CASE WHEN g >= {K.MIN_MEMBERS_FE} THEN 10 * b END, 6) AS slope_per_decade,
       ROUND(CASE WHEN g >= {K.MIN_MEMBERS_FE} THEN 10 * se END, 6) AS se,
       ROUND(CASE WHEN g >= {K.MIN_MEMBERS_FE} THEN b / se END, 6) AS z,
       ROUND(CASE WHEN g >= {K.MIN_MEMBERS_FE} THEN {_p_sql("(b / se)")} END, 6) AS p FROM done""").replace("\n\n, dev", ",\ndev")


@register("fe_wls", _FE)
def fe_wls(spark, root):
    """Within-author slope (author fixed effects, weights n, clustered by
    author, two-sided normal p) on year-demeaned author-year cells of long-span authors."""
    return P.within_unit_slope(_fe_cells(spark, root), "author", "anger_dev", "age_at_tweet")


@register("panel_cells", _fe("SELECT author, year, ROUND(anger_dev, 6) AS anger_dev, ROUND(age_at_tweet, 6) AS age_at_tweet, "
                             "n, party FROM kept"))
def panel_cells(spark, root):
    """The author-year cells kept for the fixed-effects fit."""
    return _fe_cells(spark, root)


# ---- volume vs rate per author (G9, F9, E16) ----------------------------------------------

def _volume(spark, root):
    d = msgs(spark, root).withColumn("angry", (F.col("anger") > K.ANGRY_THRESHOLD).cast("int"))
    per = latest(d, "author", ["author_name", "party", "state"], sums=[
        F.count(F.lit(1)).alias("n"), F.sum("angry").alias("a"), F.min("ts").alias("from"), F.max("ts").alias("to")], totals=[
        F.sum("n").alias("n"), (F.sum("a") / F.sum("n")).alias("share_angry"),
        (F.datediff(F.to_date(F.max("to")), F.to_date(F.min("from"))) + 1).alias("active_days")])
    per = per.withColumn("tweets_per_day", F.col("n") / F.col("active_days")).withColumn(
        "tweets_per_year", F.col("tweets_per_day") * F.lit(K.DAYS_PER_YEAR))
    per = per.withColumn("angry_per_day", F.col("tweets_per_day") * F.col("share_angry")).withColumn(
        "calm_per_day", F.col("tweets_per_day") * (F.lit(1.0) - F.col("share_angry")))  # B20
    return per.select("author", F.col("author_name").alias("name"), "party", "state", "n", "active_days",
                      "tweets_per_year", "tweets_per_day", "share_angry", "angry_per_day", "calm_per_day")


_VOL = f"""SELECT author, arg_max(author_name, (ts, msg_id)) AS name, arg_max(party, (ts, msg_id)) AS party,
       arg_max(state, (ts, msg_id)) AS state, count(*) AS n,
       CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1 AS INTEGER) AS active_days,
       count(*) / (date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1) * {K.DAYS_PER_YEAR} AS tweets_per_year,
       count(*) / (date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1) AS tweets_per_day,
       avg(CAST(anger > 0.5 AS INTEGER)) AS share_angry FROM m GROUP BY author"""
_VOL_COLS = """author, name, party, state, n, active_days, ROUND(tweets_per_year, 6) AS tweets_per_year,
       ROUND(tweets_per_day, 6) AS tweets_per_day, ROUND(share_angry, 6) AS share_angry,
       ROUND(tweets_per_day * share_angry, 6) AS angry_per_day, ROUND(tweets_per_day * (1.0 - share_angry), 6) AS calm_per_day"""


@register("volume_rate", O.with_views(f"SELECT {_VOL_COLS} FROM v", m=O.MSGS, v=_VOL))
def volume_rate(spark, root):
    """Per author volume (per day over the active span, per year) and angry share."""
    return _volume(spark, root)


@register("loudest", O.with_views(f"""SELECT {_VOL_COLS} FROM v WHERE n >= {VOLUME_MIN}
ORDER BY tweets_per_year DESC, author LIMIT 12""", m=O.MSGS, v=_VOL))
def loudest(spark, root):
    """The 12 most prolific authors above a volume floor."""
    v = _volume(spark, root).filter(F.col("n") >= VOLUME_MIN)
    return v.orderBy(F.desc("tweets_per_year"), "author").limit(12)


@register("median_rate", O.with_views("""SELECT ROUND(median(tweets_per_day), 6) AS median_per_day,
       ROUND(avg(CAST(share_angry AS DOUBLE)), 6) AS mean_share FROM v""", m=O.MSGS, v=_VOL))
def median_rate(spark, root):
    """The median per-day rate over authors and the mean angry share."""
    v = _volume(spark, root)
    mid = P.exact_median(v, "tweets_per_day").select(F.col("median").alias("median_per_day"))
    return mid.withColumn("mean_share", F.lit(v.agg(F.avg("share_angry")).first()[0]))


@register("spearman_volume", O.with_views("""SELECT ROUND(corr(ra, rb), 6) AS rho, count(*) AS n FROM (
  SELECT rank() OVER (ORDER BY tweets_per_day) + (count(*) OVER (PARTITION BY tweets_per_day) - 1) / 2.0 AS ra,
         rank() OVER (ORDER BY share_angry) + (count(*) OVER (PARTITION BY share_angry) - 1) / 2.0 AS rb FROM v) r""",
                                           m=O.MSGS, v=_VOL))
def spearman_volume(spark, root):
    """Spearman rank correlation between volume and angry share across authors."""
    return P.spearman(_volume(spark, root), "tweets_per_day", "share_angry")
