"""Row enrichment: dedup, normalisation, zone clock, election cycle, age, tenure
(B1-B3, B12, C1-C7, D2-D5, F1, L4-L6).

Everything is a narrow projection except three joins: the literal zone table
(broadcast, fixed size), the author table and the tenure table.  The latter two are
derived tables of people, joined without a hint: AQE measures them when their stage
materialises and broadcasts them below the runtime threshold, else keeps a
sort-merge join and splits skewed (hot-author) partitions.  The tenure table is
first folded to one array row per person, so the interval test is an expression
and the join cannot multiply rows.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import calendar as cal
from .joins import fixed_broadcast


def normalise_chamber(chamber="chamber") -> F.Column:
    """B2: four spellings -> two chambers, anything else NULL."""
    c = F.col(chamber) if isinstance(chamber, str) else chamber
    return (F.when(c.isin(*K.SENATE_SPELLINGS), "Senate")
             .when(c.isin(*K.HOUSE_SPELLINGS), "House"))


def normalise_state(state="state", aliases: dict = K.STATE_ALIASES) -> F.Column:
    """Territory spellings -> postal codes; other values unchanged."""
    s = F.col(state) if isinstance(state, str) else state
    expr = None
    for k, v in aliases.items():
        expr = F.when(s == k, v) if expr is None else expr.when(s == k, v)
    return expr.otherwise(s)


def dedup_first(df: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """keep one row per id -- the smallest by ``order``, ties by a hash of the whole row,
    so the pick is repeatable (rows that agree in everything are one row).

    The ids are counted first, without the rows. Rows whose id is theirs alone are passed on
    where they stand: they meet the table of repeated ids by an anti-join, which Spark broadcasts
    if that table is small. Only rows of repeated ids are grouped (``min_by``, combined in each
    task before the shuffle, so an id repeated a million times arrives as one row per task).
    A null id is an id like any other."""
    others = [c for c in df.columns if c != id_col]
    rank = F.struct(*[F.col(c) for c in order], F.xxhash64(*[F.col(c) for c in others]))
    again = df.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_id")
    same = df[id_col].eqNullSafe(again["_id"])
    best = df.join(again, same, "left_semi").groupBy(id_col).agg(
        F.min_by(F.struct(*[F.col(c) for c in others]), rank).alias("_r"))
    best = best.select(id_col, *[F.col(f"_r.{c}").alias(c) for c in others])
    return df.join(again, same, "left_anti").select(id_col, *others).unionByName(best)


def zone_table(spark: SparkSession, pairs=K.STATE_TZ) -> DataFrame:
    """A10: the literal state -> IANA zone table."""
    return spark.createDataFrame(list(pairs), "state string, tz string")


def add_zone_hour(df: DataFrame, zones: DataFrame, state: str = "state", ts: str = "ts",
                  out: str = "hour_local", default_zone: str = K.DEFAULT_ZONE) -> DataFrame:
    """Hour of ``ts`` in the home-state zone (default zone if unknown).
    The zone table is a fixed literal list (56 rows), so it is broadcast."""
    z = fixed_broadcast(zones.select(F.col("state").alias("_zs"), F.col("tz").alias("_tz")))
    joined = df.join(z, df[state] == z["_zs"], "left")
    return joined.withColumn(out, cal.local_hour(ts, "_tz", default_zone)).drop("_zs", "_tz")


def add_calendar(df: DataFrame, ts: str = "ts", zone: str = K.DEFAULT_ZONE) -> DataFrame:
    """The calendar and election-cycle features.

    ``year`` is the UTC year; hour, weekday and month are read in ``zone``."""
    et = cal.in_zone(ts, zone)
    out = (df.withColumn("created_at_et", et)
             .withColumn("year", F.year(ts))
             .withColumn("hour_et", F.hour("created_at_et"))
             .withColumn("dow_et", cal.dow0("created_at_et"))
             .withColumn("month", F.month("created_at_et"))
             .withColumn("season", cal.season("month"))
             .withColumn("is_election_year", cal.is_election_year("year"))
             .withColumn("is_presidential", cal.is_presidential("year"))
             .withColumn("next_election", cal.next_election(ts)))
    return (out.withColumn("days_to_election", cal.days_between(ts, "next_election"))
               .withColumn("cycle_phase", cal.cycle_phase("days_to_election")))


def add_age(df: DataFrame, birthday: str = "birthday", ts: str = "ts", out: str = "age_at_tweet") -> DataFrame:
    """Age in years at the message date."""
    return df.withColumn(out, cal.age_years(birthday, ts))


def fold_terms(terms: DataFrame, person: str = "author", start: str = "term_start", end: str = "term_end") -> DataFrame:
    """L4-L6 helper: one row per person with the array of that person's terms."""
    return terms.groupBy(person).agg(
        F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e"))).alias("_terms"))


def add_in_office(df: DataFrame, terms: DataFrame, person: str = "author", ts: str = "ts",
                  start: str = "term_start", end: str = "term_end", out: str = "in_office") -> DataFrame:
    """``EXISTS (term of the same person with start <= date(ts) <= end)``.

    The terms are folded to one array per person (a person holds a few dozen terms
    at most), left-joined on the person key and tested with ``exists``; the join is
    one-to-one, so messages are never duplicated and AQE can split a hot author."""
    per_person = fold_terms(terms, person, start, end)
    joined = df.join(per_person, person, "left")
    return joined.withColumn(out, in_office_flag("_terms", ts)).drop("_terms")


def in_office_flag(terms_col: str = "_terms", ts: str = "ts") -> F.Column:
    """D4 expression: does any (s, e) term of the folded array contain the UTC date of
    ``ts``; use it when the folded terms were joined together with other per-person
    attributes (one join of the messages instead of two)."""
    d = F.to_date(F.col(ts))
    return F.coalesce(F.exists(terms_col, lambda t: d.between(t["s"], t["e"])), F.lit(False))


def enrich_messages(spark: SparkSession, messages: DataFrame, authors: DataFrame, terms: DataFrame,
                    id_col: str = "msg_id", handle: str = "author_handle",
                    source: str = "source_corpus") -> DataFrame:
    """The full enrichment step (F1 -> D2 -> D3 -> C1..C7 -> D4), in that order:
    dedup runs over the whole corpus before any filter."""
    m = messages.withColumn("chamber", normalise_chamber("chamber")).withColumn("state", normalise_state("state"))
    m = dedup_first(m, id_col, [source])
    # one people-sized table (author attributes + folded terms) so the messages are
    # joined once on the handle rather than once per person attribute source
    a = authors.filter(F.col("is_congress") & F.col("birthday").isNotNull()).select(
        handle, "bioguide", "birthday", "gender")
    a = a.join(fold_terms(terms, "bioguide"), "bioguide", "left")
    m = m.filter(F.col("ts") >= F.lit(K.EARLIEST_VALID_TS).cast("timestamp_ntz")).join(a, handle)
    m = add_zone_hour(m, zone_table(spark))
    m = add_calendar(m)
    m = add_age(m)
    return m.withColumn("in_office", in_office_flag("_terms")).drop("_terms")


def scored_view(messages: DataFrame, scores: DataFrame | None = None, id_col: str = "msg_id",
                years: tuple[int, int] | None = None, in_office: str | None = "in_office",
                score: str = "anger", threshold: float = K.ANGRY_THRESHOLD) -> DataFrame:
    """The analysis view every result table starts from: enriched messages joined to
    their scores on the id (D1, a fact-to-fact shuffle join -- bucket both tables by
    the id to remove it), kept when written in office and inside a year range, with
    the 0/1 flag of the score passing the threshold (B9, B11)."""
    d = messages if scores is None else messages.join(scores, id_col)
    if in_office:
        d = d.filter(F.col(in_office))
    if years:
        d = d.filter(F.col("year").between(*years))
    return d.withColumn("is_angry", (F.col(score) > F.lit(threshold)).cast("int"))
