"""Age, generation and tenure queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import calendar as cal
from ..operators import battery as B
from ..operators.enrich import add_in_office
from ..operators.export import spine_align
from . import oracle_views as O
from .registry import register
from .views import analysis_posts, author_terms, posts

MIN_N = 30
AGE_LO, AGE_HI = K.AGE_RANGE
# Era cuts for the test corpus (1995-2001); the reference's presidential cuts are the default
# of ``calendar.era`` and would put every test message in one era.
POST_ERAS = [("1997-01-20", "first"), ("2001-01-20", "second")]
POST_ERA_LAST = "third"
POST_ERA_ORDER = ["first", "second", "third"]


def age_view(spark, root):
    d = analysis_posts(spark, root).filter(F.col("age_at_tweet").between(AGE_LO, AGE_HI))
    return d.withColumn("age_bracket", cal.fixed_bin("age_at_tweet")).withColumn("generation", cal.generation("birthday"))


_GEN_SQL = " ".join(f"WHEN year(birthday) <= {y} THEN '{g}'" for y, g in K.GENERATION_CUTS)
AGE = f"""SELECT d.*, CAST(floor(age_at_tweet / 5) * 5 AS INTEGER) AS age_bracket,
       CASE {_GEN_SQL} ELSE '{K.GENERATION_LAST}' END AS generation
FROM ({O.D_POSTS}) d WHERE age_at_tweet BETWEEN {AGE_LO} AND {AGE_HI}"""


def _a(body):
    return O.with_views(body, a=AGE)


@register("age_bracket_dev", _a(O.battery_sql("a", ["year", "age_bracket"], MIN_N, means=("anger", "negative", "joy"),
                                             within=["year"], members="author")))
def age_bracket_dev(spark, root):
    """Five-year age bracket x year, distinct authors, deviation from the year mean."""
    cells = B.mean_battery(age_view(spark, root), ["year", "age_bracket"], means=("anger", "negative", "joy"),
                           min_n=MIN_N, distinct_of="author")
    return B.deviation_within(cells, "year")


@register("generation_dev", _a(O.battery_sql("a", ["year", "generation"], MIN_N, means=("anger",),
                                            within=["year"], members="author", se=False)))
def generation_dev(spark, root):
    """Generation x year with deviation."""
    cells = B.mean_battery(age_view(spark, root), ["year", "generation"], means=("anger",), se_of=None,
                           min_n=MIN_N, distinct_of="author")
    return B.deviation_within(cells, "year")


@register("age_party_dev", _a(O.battery_sql("a", ["year", "party", "age_bracket"], 10,
                                           "party IN ('Democrat', 'Republican')", means=("anger",),
                                           within=["year", "party"], se=False, share=False)))
def age_party_dev(spark, root):
    """Year x party x age bracket, deviation within year and party."""
    cells = B.mean_battery(age_view(spark, root), ["year", "party", "age_bracket"], means=("anger",), share_of=None,
                           se_of=None, min_n=10, where=F.col("party").isin(*K.MAIN_GROUPS))
    return B.deviation_within(cells, ["year", "party"])


_TENURE_SQL = O.with_views("""SELECT year, in_office, count(*) AS n FROM (
  SELECT p.year, EXISTS (SELECT 1 FROM t WHERE t.author = p.author AND CAST(p.ts AS DATE) BETWEEN t.term_start AND t.term_end)
         AS in_office FROM p) x GROUP BY 1, 2""", p=O.POSTS, t=O.TERMS)


@register("in_office_flag", _TENURE_SQL)
def in_office_flag(spark, root):
    """Interval existence flag (message date inside one of the author's terms)."""
    p = add_in_office(posts(spark, root), author_terms(spark, root), person="author")
    return p.groupBy("year", "in_office").agg(F.count(F.lit(1)).alias("n"))


_ERA_SQL = " ".join(f"WHEN ts < TIMESTAMP '{c}' THEN '{lab}'" for c, lab in POST_ERAS)
_HOLDER_SQL = "map {" + ", ".join(f"'{e}': '{p}'" for e, p in zip(POST_ERA_ORDER, K.ERA_PARTY)) + "}[s.era]"
_SPINE = " UNION ALL ".join(f"SELECT '{p}' AS party, '{e}' AS era" for p in K.MAIN_GROUPS for e in POST_ERA_ORDER)


POST_ERA_HOLDER = dict(zip(POST_ERA_ORDER, K.ERA_PARTY))  # the party that holds the office in each era


@register("era_group_grid", O.with_views(f"""SELECT s.party, s.era, {_HOLDER_SQL} AS holder, c.n, ROUND(c.anger, 6) AS anger
FROM ({_SPINE}) s LEFT JOIN (
  SELECT party, CASE {_ERA_SQL} ELSE '{POST_ERA_LAST}' END AS era, count(*) AS n, avg(anger) AS anger
  FROM d WHERE party IN ('Democrat', 'Republican') GROUP BY 1, 2) c ON c.party = s.party AND c.era = s.era""",
                                         d=O.D_POSTS))
def era_group_grid(spark, root):
    """Group x era grid with the holder's party, aligned to the full spine (missing
    cells NULL)."""
    d = analysis_posts(spark, root).filter(F.col("party").isin(*K.MAIN_GROUPS))
    d = d.withColumn("era", cal.era("ts", POST_ERAS, POST_ERA_LAST))
    cells = d.groupBy("party", "era").agg(F.count(F.lit(1)).alias("n"), F.avg("anger").alias("anger"))
    spine = spark.createDataFrame([(p, e, POST_ERA_HOLDER[e]) for p in K.MAIN_GROUPS for e in POST_ERA_ORDER],
                                  "party string, era string, holder string")
    return spine_align(cells, spine, ["party", "era"])
