"""Enrichment and corpus-profile queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import enrich as EN
from ..operators import link as L
from ..sources.files import span_summary
from . import oracle_views as O
from .registry import register
from .views import msgs

SECOND_CORPUS_TOPICS = ["click", "view"]


def corpus(spark, root):
    """Two overlapping collections of the same messages (ids repeat across them)."""
    m = msgs(spark, root).select("msg_id", F.col("handle").alias("author_handle"), "author_name", "party", "chamber",
                                 "state", "ts", "text", "topic", "anger")
    a = m.withColumn("source_corpus", F.lit("a"))
    b = (m.filter(F.col("topic").isin(*SECOND_CORPUS_TOPICS))
          .withColumn("text", F.concat("text", F.lit(" [b]"))).withColumn("source_corpus", F.lit("b")))
    return a.unionByName(b)


def corpus_authors(spark, root):
    c = corpus(spark, root)
    s = L.author_summary(c)
    k = F.expr("substring(author_handle, 2)").cast("long")
    return s.select("*", F.concat(F.lit("P"), k.cast("string")).alias("bioguide"),
                    F.when(k % 10 == 9, F.lit(None).cast("date"))
                     .otherwise(F.date_add(F.lit("1950-01-01").cast("date"), ((k * 97) % 15000).cast("int"))).alias("birthday"),
                    F.when(k % 2 == 0, "F").otherwise("M").alias("gender"))


def corpus_terms(spark, root):
    a = corpus_authors(spark, root)
    k = F.expr("substring(author_handle, 2)").cast("long")
    start = F.date_add(F.lit("2023-07-01").cast("date"), ((k * 3) % 200).cast("int"))
    return a.select("bioguide", start.alias("term_start"), F.date_add(start, 365).alias("term_end"))


def enriched(spark, root):
    return EN.enrich_messages(spark, corpus(spark, root), corpus_authors(spark, root), corpus_terms(spark, root))


_CORPUS = f"""SELECT msg_id, handle AS author_handle, author_name, party, chamber, state, ts, text, topic, anger, 'a' AS source_corpus
FROM ({O.MSGS}) m
UNION ALL
SELECT msg_id, handle, author_name, party, chamber, state, ts, text || ' [b]', topic, anger, 'b'
FROM ({O.MSGS}) m WHERE topic IN ('click', 'view')"""
_AUTHORS = """SELECT author_handle, max(author_name) AS author_name, max(state) AS state,
       avg(CAST(coalesce(chamber IN ('Senate', 'House', 'representative', 'senator'), false) AS INTEGER)) > 0.5 AS is_congress,
       count(*) AS n_tweets, 'P' || substr(author_handle, 2) AS bioguide,
       CASE WHEN CAST(substr(author_handle, 2) AS BIGINT) % 10 = 9 THEN NULL
            ELSE DATE '1950-01-01' + CAST((CAST(substr(author_handle, 2) AS BIGINT) * 97) % 15000 AS INTEGER) END AS birthday,
       CASE WHEN CAST(substr(author_handle, 2) AS BIGINT) % 2 = 0 THEN 'F' ELSE 'M' END AS gender
FROM c GROUP BY author_handle"""
_TERMS = """SELECT bioguide, DATE '2023-07-01' + CAST((CAST(substr(bioguide, 2) AS BIGINT) * 3) % 200 AS INTEGER) AS term_start,
       DATE '2023-07-01' + CAST((CAST(substr(bioguide, 2) AS BIGINT) * 3) % 200 AS INTEGER) + 365 AS term_end FROM a"""
# Oracle: the kept row of each id by DISTINCT ON, spellings and territories by lookup, tenure
# by counting the terms around the date.
_KEPT = """SELECT DISTINCT ON (msg_id) * REPLACE (
         coalesce(map {'MARIANA': 'MP', 'GUAM': 'GU'}[state], state) AS state,
         map {'Senate': 'Senate', 'senator': 'Senate', 'House': 'House', 'representative': 'House'}[chamber] AS chamber)
FROM c ORDER BY msg_id, source_corpus"""
_ENRICHED = f"""SELECT k.msg_id, a.bioguide, k.chamber, k.state, k.ts, k.source_corpus, a.birthday, CAST(year(k.ts) AS INTEGER) AS year,
       CAST(hour(timezone(coalesce(z.tz, '{K.DEFAULT_ZONE}'), timezone('UTC', k.ts))) AS INTEGER) AS hour_local
FROM ({_KEPT}) k JOIN (SELECT * FROM a WHERE is_congress AND birthday IS NOT NULL) a USING (author_handle)
LEFT JOIN ({O.ZONES}) z ON z.state = k.state
WHERE k.ts >= TIMESTAMP '{K.EARLIEST_VALID_TS}'"""
_E_COLS = ["chamber", "state", "source_corpus", "hour_local", "hour_et", "dow_et", "month", "season", "is_election_year",
           "is_presidential", "next_election", "days_to_election", "cycle_phase", "age_at_tweet"]
_E_BODY = "SELECT msg_id, e.bioguide, " + ", ".join(f"min({c}) AS {c}" for c in _E_COLS) + """, count(term_owner) > 0 AS in_office
FROM (SELECT msg_id, bioguide, chamber, state, source_corpus, hour_local, hour_et, dow_et, month, season, is_election_year,
             is_presidential, next_election, days_to_election, ROUND(cycle_phase, 6) AS cycle_phase,
             ROUND((CAST(ts AS DATE) - birthday) / 365.25, 6) AS age_at_tweet, CAST(ts AS DATE) AS on_day
      FROM (""" + O.CALENDAR + """) q) e
LEFT JOIN (SELECT bioguide AS term_owner, term_start, term_end FROM tm) t
  ON t.term_owner = e.bioguide AND e.on_day >= t.term_start AND e.on_day <= t.term_end
GROUP BY msg_id, e.bioguide"""


def _e(body):
    return O.with_views(body, c=_CORPUS, a=_AUTHORS, tm=_TERMS, en=_ENRICHED)


@register("enriched_messages", _e(_E_BODY.replace("@SRC@", "SELECT * FROM en")))
def enriched_messages(spark, root):
    """The full enrichment step on a two-corpus feed:
    dedup over the whole corpus first, author join, zone hour, Eastern calendar,
    election cycle, age, in-office flag."""
    e = enriched(spark, root)
    return e.select("msg_id", "bioguide", "chamber", "state", "source_corpus", "hour_local", "hour_et", "dow_et",
                    "month", "season", "is_election_year", "is_presidential", "next_election", "days_to_election",
                    "cycle_phase", "age_at_tweet", "in_office")


@register("dedup_first", _e("""SELECT source_corpus, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
  SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY source_corpus) AS rn FROM c) t WHERE rn = 1 GROUP BY 1"""))
def dedup_first(spark, root):
    """one row per id, the first collection wins (dedup precedes every filter)."""
    d = EN.dedup_first(corpus(spark, root), "msg_id", ["source_corpus"])
    return d.groupBy("source_corpus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@register("duplicate_ids", _e("SELECT count(*) - count(DISTINCT msg_id) AS dup_ids, count(*) AS n_rows FROM c"))
def duplicate_ids(spark, root):
    """Rows minus distinct ids in the raw feed."""
    return corpus(spark, root).agg((F.count(F.lit(1)) - F.count_distinct("msg_id")).alias("dup_ids"),
                                   F.count(F.lit(1)).alias("n_rows"))


@register("chamber_state_norm", _e("""SELECT CASE WHEN chamber IN ('Senate', 'senator') THEN 'Senate'
       WHEN chamber IN ('House', 'representative') THEN 'House' END AS chamber,
       CASE WHEN state = 'MARIANA' THEN 'MP' WHEN state = 'GUAM' THEN 'GU' ELSE state END AS state, count(*) AS n
FROM c GROUP BY 1, 2"""))
def chamber_state_norm(spark, root):
    """Chamber spellings -> two chambers (else NULL), territory names -> codes."""
    c = corpus(spark, root)
    return c.groupBy(EN.normalise_chamber("chamber").alias("chamber"), EN.normalise_state("state").alias("state")).agg(
        F.count(F.lit(1)).alias("n"))


_QS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


_QLIST = "CAST([" + ", ".join(str(q) for q in _QS) + "] AS DOUBLE[])"


@register("age_quantiles", _e(f"""SELECT q, ROUND(v, 6) AS v FROM (
  SELECT unnest({_QLIST}) AS q,
         unnest(quantile_cont(date_diff('day', birthday, CAST(ts AS DATE)) / 365.25, {_QLIST})) AS v FROM en) y"""))
def age_quantiles(spark, root):
    """Exact interpolated quantiles of age at message time."""
    e = enriched(spark, root)
    one = e.agg(F.percentile("age_at_tweet", _QS).alias("_v"))
    qs = F.array(*[F.lit(q) for q in _QS])
    return one.select(F.posexplode("_v").alias("_i", "v")).select(F.element_at(qs, F.col("_i") + 1).alias("q"), "v")


@register("span_summary", _e("""SELECT count(*) AS rows, count(DISTINCT bioguide) AS members, CAST(min(ts) AS DATE) AS "first",
       CAST(max(ts) AS DATE) AS "last", count(*) - count(DISTINCT msg_id) AS dup_ids FROM en"""))
def span_summary_q(spark, root):
    """Rows, distinct authors and the covered dates of the enriched table."""
    return span_summary(EN.enrich_messages(spark, corpus(spark, root), corpus_authors(spark, root),
                                           corpus_terms(spark, root)), "msg_id", "bioguide", "ts")
