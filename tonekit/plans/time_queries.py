"""Time batteries: year, hour, weekday, month, season, election cycle."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import calendar as cal
from ..operators import battery as B
from . import oracle_views as O
from .registry import register
from .views import analysis_posts, local_msgs

MIN_N = 30  # the reference's sample floor; its full-corpus floors empty every cell at this scale
MIN_N_WEEK = 5  # weekly party cells are thin at test scale
UNFINISHED_YEAR = 2000  # the year the collection is still in
MAIN = "party IN ('Democrat', 'Republican')"
MSG_MEANS = ("anger", "negative", "disgust", "joy")


def _two_party():
    return F.col("party").isin(*K.MAIN_GROUPS)


def _d(body: str, text: bool = False) -> str:
    return O.with_views(body, d=O.D_POSTS_TEXT if text else O.D_POSTS)


def _m(body: str) -> str:
    return O.with_views(body, m=O.MSGS_LOCAL)


@register("year_battery", _d(O.battery_sql("d", ["year"], MIN_N).replace(
    " FROM (SELECT year,", ", ROUND(1.96 * anger_se, 6) AS anger_ci FROM (SELECT year,", 1)))
def year_battery(spark, root):
    """The mean battery by year with the 95 % half-width."""
    cells = B.mean_battery(analysis_posts(spark, root), ["year"], min_n=MIN_N)
    return cells.withColumn("anger_ci", B.error_bar())


@register("year_party_battery", _d(O.battery_sql("d", ["year", "party"], MIN_N, MAIN)))
def year_party_battery(spark, root):
    """G1: by year and party, two main parties only."""
    return B.mean_battery(analysis_posts(spark, root), ["year", "party"], min_n=MIN_N, where=_two_party())


@register("hour_dev", _m(O.battery_sql("m", ["year", "hour_local"], MIN_N, means=MSG_MEANS, within=["year"])))
def hour_dev(spark, root):
    """Local hour x year with deviation from the year mean."""
    cells = B.mean_battery(local_msgs(spark, root), ["year", "hour_local"], means=MSG_MEANS, min_n=MIN_N)
    return B.deviation_within(cells, "year")


@register("hour_party_dev", _m(O.battery_sql("m", ["year", "party", "hour_local"], MIN_N, MAIN,
                                            means=MSG_MEANS, within=["year", "party"])))
def hour_party_dev(spark, root):
    """Local hour x year x party, deviation within year and party."""
    cells = B.mean_battery(local_msgs(spark, root), ["year", "party", "hour_local"], means=MSG_MEANS,
                           min_n=MIN_N, where=_two_party())
    return B.deviation_within(cells, ["year", "party"])


@register("dow_dev", _d(O.battery_sql("d", ["year", "dow_et"], MIN_N, within=["year"])))
def dow_dev(spark, root):
    """Eastern weekday x year, deviation from the year mean."""
    return B.deviation_within(B.mean_battery(analysis_posts(spark, root), ["year", "dow_et"], min_n=MIN_N), "year")


@register("month_dev", _d(O.battery_sql("d", ["year", "month"], MIN_N, within=["year"])))
def month_dev(spark, root):
    """Eastern month x year, deviation from the year mean."""
    return B.deviation_within(B.mean_battery(analysis_posts(spark, root), ["year", "month"], min_n=MIN_N), "year")


@register("season_dev", _d(O.battery_sql("d", ["year", "season"], MIN_N, within=["year"])))
def season_dev(spark, root):
    """Season x year, deviation from the year mean."""
    return B.deviation_within(B.mean_battery(analysis_posts(spark, root), ["year", "season"], min_n=MIN_N), "year")


_CYCLE_SQL = _d(f"""SELECT cycle, weeks_to_election, n, ROUND(anger, 6) AS anger, ROUND(share_angry, 6) AS share_angry,
       ROUND(negative, 6) AS negative,
       ROUND(anger - sum(anger * n) OVER (PARTITION BY cycle) / sum(n) OVER (PARTITION BY cycle), 6) AS anger_dev
FROM (SELECT CAST(year(next_election) AS INTEGER) AS cycle, CAST(floor(days_to_election / 7) AS INTEGER) AS weeks_to_election,
             count(*) AS n, avg(anger) AS anger, avg(CAST(anger > 0.5 AS INTEGER)) AS share_angry, avg(negative) AS negative
      FROM d GROUP BY 1, 2 HAVING count(*) >= {MIN_N}) c""")


def _cycle_cols(df):
    return (df.withColumn("cycle", F.year("next_election"))
              .withColumn("weeks_to_election", cal.week_index("days_to_election")))


@register("cycle_week_dev", _CYCLE_SQL)
def cycle_week_dev(spark, root):
    """Election cycle x weeks to election, deviation within the cycle."""
    d = _cycle_cols(analysis_posts(spark, root))
    cells = B.mean_battery(d, ["cycle", "weeks_to_election"], means=("anger", "negative"), se_of=None, min_n=MIN_N)
    return B.deviation_within(cells, "cycle")


@register("cycle_week_party", _d(f"""SELECT CAST(year(next_election) AS INTEGER) AS cycle, party,
       CAST(floor(days_to_election / 7) AS INTEGER) AS weeks_to_election, count(*) AS n, ROUND(avg(anger), 6) AS anger
FROM d WHERE {MAIN} GROUP BY 1, 2, 3 HAVING count(*) >= {MIN_N_WEEK}"""))
def cycle_week_party(spark, root):
    """Cycle x party x weeks, no deviation."""
    d = _cycle_cols(analysis_posts(spark, root))
    return B.mean_battery(d, ["cycle", "party", "weeks_to_election"], means=("anger",), share_of=None,
                          se_of=None, min_n=MIN_N_WEEK, where=_two_party())


@register("election_years", _d(O.battery_sql("d", ["year", "is_election_year", "is_presidential"], MIN_N)))
def election_years(spark, root):
    """Election vs off years."""
    return B.mean_battery(analysis_posts(spark, root), ["year", "is_election_year", "is_presidential"], min_n=MIN_N)


@register("election_pooled", _d(f"""SELECT is_election_year, is_presidential, count(*) AS years,
       ROUND(sum(anger * n) / sum(n), 6) AS anger
FROM (SELECT year, is_election_year, is_presidential, count(*) AS n, avg(anger) AS anger FROM d
      GROUP BY 1, 2, 3 HAVING count(*) >= {MIN_N}) c GROUP BY 1, 2"""))
def election_pooled(spark, root):
    """The yearly cells pooled by the two flags, n-weighted."""
    cells = B.mean_battery(analysis_posts(spark, root), ["year", "is_election_year", "is_presidential"],
                           means=("anger",), share_of=None, se_of=None, min_n=MIN_N)
    return B.weighted_mean(cells, ["is_election_year", "is_presidential"], "anger", count="years")


@register("final_stretch", _d("""SELECT year, ROUND(avg(CASE WHEN days_to_election <= 28 THEN anger END), 6) AS last4,
       ROUND(avg(CASE WHEN days_to_election > 28 THEN anger END), 6) AS rest
FROM d WHERE is_election_year AND year < {UNFINISHED_YEAR} GROUP BY year""".replace("{UNFINISHED_YEAR}", str(UNFINISHED_YEAR))))
def final_stretch(spark, root):
    """Last four weeks before the election vs the rest of the election year, finished
    years only."""
    d = analysis_posts(spark, root).filter(F.col("is_election_year") & (F.col("year") < UNFINISHED_YEAR))
    return d.groupBy("year").agg(
        F.avg(F.when(F.col("days_to_election") <= 28, F.col("anger"))).alias("last4"),
        F.avg(F.when(F.col("days_to_election") > 28, F.col("anger"))).alias("rest"))


@register("party_age_by_year", _d("""SELECT year, ROUND(avg(CASE WHEN party = 'Democrat' THEN age_at_tweet END), 6) AS dem,
       ROUND(avg(CASE WHEN party = 'Republican' THEN age_at_tweet END), 6) AS rep FROM d GROUP BY year"""))
def party_age_by_year(spark, root):
    """Mean age by year for each main party (conditional means)."""
    d = analysis_posts(spark, root)
    return d.groupBy("year").agg(
        F.avg(F.when(F.col("party") == "Democrat", F.col("age_at_tweet"))).alias("dem"),
        F.avg(F.when(F.col("party") == "Republican", F.col("age_at_tweet"))).alias("rep"))


@register("local_hour", _m("SELECT state, hour_local, count(*) AS n FROM m GROUP BY state, hour_local"))
def local_hour(spark, root):
    """Messages by normalised state and home-zone hour."""
    return local_msgs(spark, root).groupBy("state", "hour_local").agg(F.count(F.lit(1)).alias("n"))


@register("argmax_hour", _m(f"""SELECT year, hour_local, ROUND(anger_dev, 6) AS anger_dev FROM (
  SELECT *, row_number() OVER (PARTITION BY year ORDER BY anger_dev DESC, hour_local) AS rn FROM (
    SELECT year, hour_local, anger - sum(anger * n) OVER (PARTITION BY year) / sum(n) OVER (PARTITION BY year) AS anger_dev
    FROM (SELECT year, hour_local, count(*) AS n, avg(anger) AS anger FROM m GROUP BY 1, 2 HAVING count(*) >= {MIN_N}) c) x) y
WHERE rn = 1"""))
def argmax_hour(spark, root):
    """F8: the angriest local hour of each year (largest deviation; ties -> earlier hour)."""
    cells = B.mean_battery(local_msgs(spark, root), ["year", "hour_local"], means=("anger",), share_of=None,
                           se_of=None, min_n=MIN_N)
    return B.argmax_per_group(B.deviation_within(cells, "year"), "year", "anger_dev", ["hour_local"])
