"""Author linkage queries.

Analog inputs, all derived from the customer and order tables: people are
customers with names built from the key (so namesakes and accents occur), authors
are the order authors with display names in the assorted formats of a scraped
corpus, and a social-handle table covers a third of the people over several
snapshots (a later snapshot can disagree; the earliest wins).
"""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import link as L
from ..operators.joins import fixed_broadcast
from ..sources.files import read_table
from . import oracle_views as O
from .registry import register
from .views import author_terms

FIRSTS = ["Ana", "Ben", "Carla", "Dev", "Elena", "Farid", "Grace", "Hugo", "Iris", "José", "Kai", "Lena"]
LASTS = ["Sánchez", "Van Orden", "Müller", "O'Neil", "Kim", "Barton", "Nguyen", "de la Cruz", "Smith", "Okafor",
         "Larsen", "Dubois", "Rossi", "Haddad", "Kowalski", "Ito"]
NICKS = ["Annie", "Benny", "Cici", "Dee", "Ellie"]
PRIORITY_CHAMBER = {"1-URGENT": "Senate", "2-HIGH": "House", "3-MEDIUM": "representative", "4-NOT SPECIFIED": "senator"}


def _pick(arr, idx):
    return F.element_at(F.array(*[F.lit(v) for v in arr]), (idx % len(arr) + 1).cast("int"))


def _names(k):
    first = _pick(FIRSTS, k)
    last = _pick(LASTS, F.floor(k / len(FIRSTS)))
    return first, last


def people(spark, root):
    c = read_table(spark, root, "customer", ["c_custkey", "c_nationkey"])
    n = fixed_broadcast(read_table(spark, root, "nation", ["n_nationkey", "n_name"]))  # 25 rows by the schema
    ends = author_terms(spark, root).groupBy("author").agg(F.date_format(F.max("term_end"), "yyyy-MM-dd").alias("last_term_end"))
    k = F.col("c_custkey")
    first, last = _names(k)
    p = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.concat(F.lit("P"), k.cast("string")).alias("bioguide"), first.alias("first"), last.alias("last"),
        F.when(k % 7 == 0, _pick(NICKS, k)).alias("nickname"),
        F.when(k % 2 == 0, F.concat(first, F.lit(" "), last)).alias("official_full"),
        F.array(F.col("n_name")).alias("states"), k.alias("author"))
    return p.join(ends, "author").drop("author")


def handles(spark, root):
    """Two snapshots of every person's social record; the handle is empty for two thirds
    of them (a nullable field, as in the real snapshots) and a later snapshot assigns
    some handles to a different person (the earliest snapshot must win)."""
    c = read_table(spark, root, "customer", ["c_custkey"])
    k = F.col("c_custkey")
    base = c.select(F.when(k % 3 == 0, F.concat(F.lit("C"), k.cast("string"))).alias("handle"),
                    F.concat(F.lit("P"), k.cast("string")).alias("bioguide"),
                    F.concat(F.lit("social-"), (k % 4).cast("string")).alias("snapshot"))
    later = c.select(F.when(k % 6 == 0, F.concat(F.lit("c"), k.cast("string"))).alias("handle"),
                     F.concat(F.lit("P"), (k + 1).cast("string")).alias("bioguide"),
                     F.lit("social-9").alias("snapshot"))
    return base.unionByName(later)


def author_messages(spark, root):
    o = read_table(spark, root, "orders", ["o_orderkey", "o_custkey", "o_orderpriority"])
    c = read_table(spark, root, "customer", ["c_custkey", "c_nationkey"])
    n = fixed_broadcast(read_table(spark, root, "nation", ["n_nationkey", "n_name"]))  # 25 rows by the schema
    d = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
    k = F.col("o_custkey")
    first, last = _names(k)
    fmt = (k + F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0)) % 5
    name = (F.when(fmt == 0, F.concat(first, F.lit(" "), last))
             .when(fmt == 1, F.concat(last, F.lit(", "), first))
             .when(fmt == 2, F.concat(first, F.lit(" "), last, F.lit(" R-TX")))
             .when(fmt == 3, F.concat(first, F.lit(" Q. "), last, F.lit(" Jr.")))
             .otherwise(last))
    chamber = None
    for p, ch in PRIORITY_CHAMBER.items():
        cond = F.col("o_orderpriority") == p
        chamber = F.when(cond, ch) if chamber is None else chamber.when(cond, ch)
    return d.select(F.concat(F.lit("c"), k.cast("string")).alias("author_handle"), name.alias("author_name"),
                    F.when(k % 11 == 0, F.lit(None).cast("string")).when(k % 13 == 0, F.lit(""))
                     .otherwise(F.col("n_name")).alias("state"),
                    chamber.otherwise("other").alias("chamber"))


def linked(spark, root):
    authors = L.author_summary(author_messages(spark, root))
    return L.link_authors(authors, people(spark, root), handles(spark, root))


# ---- oracle ------------------------------------------------------------------------------

def _lst(vals):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in vals) + "]"


_FIRST = f"{_lst(FIRSTS)}[(k % {len(FIRSTS)}) + 1]"
_LAST = f"{_lst(LASTS)}[(CAST(floor(k / {len(FIRSTS)}) AS BIGINT) % {len(LASTS)}) + 1]"
_FOLD = "trim(regexp_replace(lower(strip_accents({x})), '[^a-z ]', '', 'g'))"


def fold(x: str) -> str:
    return _FOLD.format(x=x)


_CH = " ".join(f"WHEN o_orderpriority = '{p}' THEN '{c}'" for p, c in PRIORITY_CHAMBER.items())
LINK_SQL = f"""
, msgs AS (SELECT 'c' || CAST(k AS VARCHAR) AS author_handle,
             CASE fmt WHEN 0 THEN fi || ' ' || la WHEN 1 THEN la || ', ' || fi WHEN 2 THEN fi || ' ' || la || ' R-TX'
                      WHEN 3 THEN fi || ' Q. ' || la || ' Jr.' ELSE la END AS author_name,
             CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN '' ELSE n_name END AS state,
             CASE {_CH} ELSE 'other' END AS chamber
      FROM (SELECT o.o_orderkey, o.o_custkey AS k, o.o_orderpriority, n.n_name,
                   (o.o_custkey + CASE WHEN o.o_orderkey % 4 = 0 THEN 1 ELSE 0 END) % 5 AS fmt,
                   {_FIRST.replace('k %', 'o.o_custkey %')} AS fi,
                   {_LAST.replace('floor(k', 'floor(o.o_custkey')} AS la
            FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey) x),
nm AS (SELECT author_handle, author_name FROM (SELECT author_handle, author_name,
         row_number() OVER (PARTITION BY author_handle ORDER BY count(*) DESC, author_name) AS r
         FROM msgs WHERE author_name IS NOT NULL GROUP BY 1, 2) z WHERE r = 1),
st AS (SELECT author_handle, state FROM (SELECT author_handle, state,
         row_number() OVER (PARTITION BY author_handle ORDER BY count(*) DESC, state) AS r
         FROM msgs WHERE state IS NOT NULL GROUP BY 1, 2) z WHERE r = 1),
authors AS (SELECT h.author_handle, nm.author_name, st.state, h.is_congress, h.n_tweets
            FROM (SELECT author_handle, avg(CAST(coalesce(chamber IN ('Senate', 'House', 'representative', 'senator'), false) AS INTEGER)) > 0.5
                         AS is_congress, count(*) AS n_tweets FROM msgs GROUP BY 1) h
            LEFT JOIN nm USING (author_handle) LEFT JOIN st USING (author_handle)),
ends AS (SELECT author AS k, strftime(max(term_end), '%Y-%m-%d') AS last_term_end FROM ({O.TERMS}) t GROUP BY 1),
people AS (SELECT 'P' || CAST(c.c_custkey AS VARCHAR) AS bioguide, {_FIRST.replace('k %', 'c.c_custkey %')} AS first,
                  {_LAST.replace('floor(k', 'floor(c.c_custkey')} AS last,
                  CASE WHEN c.c_custkey % 7 = 0 THEN {_lst(NICKS)}[(c.c_custkey % {len(NICKS)}) + 1] END AS nickname,
                  CASE WHEN c.c_custkey % 2 = 0 THEN {_FIRST.replace('k %', 'c.c_custkey %')} || ' ' ||
                       {_LAST.replace('floor(k', 'floor(c.c_custkey')} END AS official_full,
                  [n.n_name] AS states, e.last_term_end
           FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN ends e ON e.k = c.c_custkey),
handles AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'C' || CAST(c_custkey AS VARCHAR) END AS handle,
                   'P' || CAST(c_custkey AS VARCHAR) AS bioguide, 'social-' || CAST(c_custkey % 4 AS VARCHAR) AS snapshot
            FROM customer
            UNION ALL
            SELECT CASE WHEN c_custkey % 6 = 0 THEN 'c' || CAST(c_custkey AS VARCHAR) END,
                   'P' || CAST(c_custkey + 1 AS VARCHAR), 'social-9' FROM customer),
seen AS (SELECT h, bioguide FROM (SELECT lower(handle) AS h, bioguide,
           row_number() OVER (PARTITION BY lower(handle) ORDER BY snapshot, bioguide) AS r
           FROM handles WHERE handle IS NOT NULL) z WHERE r = 1),
s1 AS (SELECT a.author_handle, s.bioguide, 'handle' AS match_method FROM authors a JOIN seen s ON s.h = lower(a.author_handle)),
rest AS (SELECT * REPLACE (nullif(state, '') AS state) FROM authors WHERE author_handle NOT IN (SELECT author_handle FROM s1)),
parsed AS (SELECT author_handle, state, n1, strpos(n1, ',') > 0 AS comma,
                  string_split_regex(n1, '\\s+') AS words
           FROM (SELECT author_handle, state,
                        trim(regexp_replace(trim(regexp_replace(author_name, '\\s+[DRI]-[A-Z]{{2}}$', '')),
                                            '{K.NAME_SUFFIX}', '', 'i')) AS n1 FROM rest) y),
parts AS (SELECT author_handle, state,
                 CASE WHEN comma THEN trim(substr(n1, strpos(n1, ',') + 1)) ELSE words[1] END AS first_raw,
                 CASE WHEN comma THEN string_split_regex(trim(split_part(n1, ',', 1)), '\\s+') ELSE words[2:] END AS lp
          FROM parsed WHERE comma OR len(words) >= 2),
cands AS (SELECT author_handle, state, nullif(split_part({fold('first_raw')}, ' ', 1), '') AS first,
                 {fold("array_to_string(lp[i:], ' ')")} AS last, i - 1 AS rank
          FROM (SELECT *, unnest(range(1, len(lp) + 1)) AS i FROM parts) u),
cands2 AS (SELECT * FROM cands WHERE last <> ''),
pkeys AS (SELECT DISTINCT bioguide, states, last_term_end, {fold('last')} AS last, split_part({fold('f')}, ' ', 1) AS first
          FROM (SELECT *, unnest(list_distinct(list_filter([first, nickname,
                   CASE WHEN coalesce(official_full, '') <> '' THEN split_part(official_full, ' ', 1) END],
                   lambda x: x IS NOT NULL AND x <> ''))) AS f FROM people) q),
j AS (SELECT c.author_handle, k.bioguide, row_number() OVER (PARTITION BY c.author_handle
             ORDER BY c.rank, k.last_term_end DESC, k.bioguide) AS r
      FROM cands2 c JOIN pkeys k ON k.first = c.first AND k.last = c.last
      WHERE c.state IS NULL OR list_contains(k.states, c.state)),
s2 AS (SELECT author_handle, bioguide, 'name' AS match_method FROM j WHERE r = 1),
rest2 AS (SELECT author_handle FROM rest WHERE state IS NOT NULL AND author_handle NOT IN (SELECT author_handle FROM s2)),
j2 AS (SELECT c.author_handle, c.rank, count(*) AS kk, min(p.bioguide) AS bioguide
       FROM cands2 c JOIN rest2 USING (author_handle)
       JOIN (SELECT bioguide, states, last_term_end, {fold('last')} AS last FROM people WHERE last_term_end >= '2005') p
         ON p.last = c.last AND list_contains(p.states, c.state)
       GROUP BY 1, 2),
s3 AS (SELECT author_handle, bioguide, 'lastname+state' AS match_method FROM (
         SELECT *, row_number() OVER (PARTITION BY author_handle ORDER BY rank) AS r FROM j2 WHERE kk = 1) z WHERE r = 1),
linked AS (SELECT a.*, m.bioguide, m.match_method FROM authors a
           LEFT JOIN (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3) m USING (author_handle))"""


def _l(body: str) -> str:
    return ("WITH _ AS (SELECT 1)" + LINK_SQL + "\n" + body)


@register("link_authors", _l("""SELECT author_handle, author_name, state, is_congress, n_tweets, bioguide, match_method
FROM linked"""))
def link_authors(spark, root):
    """Cascading author -> person match with the method recorded."""
    return linked(spark, root).select("author_handle", "author_name", "state", "is_congress", "n_tweets",
                                      "bioguide", "match_method")


@register("author_summary", _l("SELECT author_handle, author_name, state, is_congress, n_tweets FROM authors"))
def author_summary(spark, root):
    """Per handle, modal name and state (ties -> smallest), majority flag, count."""
    return L.author_summary(author_messages(spark, root))


@register("match_report", _l("""SELECT match_method, count(*) AS authors, CAST(sum(n_tweets) AS BIGINT) AS messages
FROM linked WHERE is_congress GROUP BY match_method"""))
def match_report(spark, root):
    """Match counts by method among congressional authors, message-weighted."""
    return L.match_report(linked(spark, root))[0]


@register("unmatched_top", _l("""SELECT author_handle, author_name, state, n_tweets FROM linked
WHERE is_congress AND bioguide IS NULL ORDER BY n_tweets DESC, author_handle LIMIT 30"""))
def unmatched_top(spark, root):
    """The 30 unmatched congressional authors with most messages."""
    return L.match_report(linked(spark, root))[1]


@register("match_coverage", _l("""SELECT count(*) AS authors, count(bioguide) AS matched,
       ROUND(sum(CASE WHEN bioguide IS NOT NULL THEN n_tweets ELSE 0 END) / sum(n_tweets), 6) AS message_coverage
FROM linked WHERE is_congress"""))
def match_coverage(spark, root):
    """Matched congressional authors and the message-weighted coverage."""
    c = linked(spark, root).filter("is_congress")
    return c.agg(F.count(F.lit(1)).alias("authors"), F.count("bioguide").alias("matched"),
                 (F.sum(F.when(F.col("bioguide").isNotNull(), F.col("n_tweets")).otherwise(0))
                  / F.sum("n_tweets")).alias("message_coverage"))
