"""DuckDB twins of the analog views, written as CTE bodies over the raw driver tables.

These are the oracle side only: the Spark side builds the same views with the
DataFrame API in :mod:`tonekit.plans.views`.
"""
from __future__ import annotations

from .. import constants as K
from .views import BIRTH_ORIGIN, BIRTH_SPAN_DAYS, BIRTH_STEP, N_HANDLES, ANGER_SCALE, SEGMENT_PARTY


def _segment_case() -> str:
    parts = " ".join(f"WHEN c.c_mktsegment = '{s}' THEN '{p}'" for s, p in SEGMENT_PARTY.items())
    return f"CASE {parts} ELSE 'Independent' END"


SCORES = """SELECT l_orderkey AS msg_id, avg(l_discount) / 0.11 AS negative, avg(l_tax) / 0.09 AS disgust,
       avg(l_quantity) / 51 AS joy, max(l_discount) / 0.11 AS optimism, min(l_quantity) / 51 AS fear,
       max(l_tax) / 0.09 AS sadness
FROM lineitem GROUP BY l_orderkey"""

POSTS = f"""SELECT o.o_orderkey AS msg_id, o.o_custkey AS author, c.c_name AS author_name,
       {_segment_case()} AS party, n.n_name AS state, r.r_name AS region, o.o_orderdate AS ts,
       CAST(year(o.o_orderdate) AS INTEGER) AS year, o.o_totalprice / {ANGER_SCALE} AS anger,
       DATE '{BIRTH_ORIGIN}' + CAST((o.o_custkey * {BIRTH_STEP}) % {BIRTH_SPAN_DAYS} AS INTEGER) AS birthday,
       s.negative, s.disgust, s.joy, s.optimism, s.fear, s.sadness
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN ({SCORES}) s ON s.msg_id = o.o_orderkey"""

NUMBERED = "SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents"  # texts are found by number

POSTS_TEXT = f"""SELECT p.*, d.text FROM ({POSTS}) p
JOIN ({NUMBERED}) d ON d.k = p.msg_id % (SELECT count(*) FROM documents)"""

TERMS = """SELECT c_custkey AS author, DATE '1994-07-01' + CAST((c_custkey * 37) % 730 AS INTEGER) AS term_start,
       DATE '1994-07-01' + CAST((c_custkey * 37) % 730 AS INTEGER) + 1460 AS term_end FROM customer
UNION ALL
SELECT c_custkey, DATE '1994-07-01' + CAST((c_custkey * 37) % 730 AS INTEGER) + 1460 + 400,
       DATE '1994-07-01' + CAST((c_custkey * 37) % 730 AS INTEGER) + 1460 + 400 + 1460 FROM customer"""


def _h(expr: str) -> str:
    return f"('U' || CAST({expr} AS VARCHAR))"


_BLOCK = f"(user_id - user_id % {N_HANDLES})"
_TGT = _h(f"{_BLOCK} + (user_id * 7 + event_id % 3) % {N_HANDLES}")
_TGT2 = _h(f"{_BLOCK} + (user_id + (event_id % 2) * 5) % {N_HANDLES}")
_STATES = ["NY", "CA", "TX", "AZ", "HI", "GUAM", "MARIANA", "ZZ"]
_CHAMBERS = ["Senate", "senator", "House", "representative"]
_ANGER = "(value / (value + 50))"
_K = "(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 99)"

MSGS = f"""SELECT event_id AS msg_id, user_id AS author, 'User ' || CAST(user_id AS VARCHAR) AS author_name,
       {_h('user_id')} AS handle,
       CASE WHEN user_id % 4 = 0 THEN 'Democrat' WHEN user_id % 4 = 1 THEN 'Republican'
            WHEN user_id % 4 = 2 THEN 'Independent' END AS party,
       CASE {' '.join(f"WHEN user_id % 9 = {k} THEN '{s}'" for k, s in enumerate(_STATES))} END AS state,
       CASE {' '.join(f"WHEN user_id % 5 = {k} THEN '{s}'" for k, s in enumerate(_CHAMBERS))} ELSE 'other' END AS chamber,
       ts, CAST(year(ts) AS INTEGER) AS year, event_type AS topic,
       CASE WHEN event_id % 5 = 0 THEN 'RT @' || {_TGT} || ': ' || event_type || ' news'
            WHEN event_id % 5 = 1 THEN 'Hey .@' || {_TGT} || ' and .@' || {_TGT2} || ' stop the ' || event_type
            WHEN event_id % 5 = 2 THEN '@' || {_TGT} || ' thanks for the ' || event_type
            WHEN event_id % 5 = 3 THEN '.@' || {_TGT} || ' we must work together on ' || event_type
            ELSE 'Proud to ' || event_type || ' today https://t.co/' || CAST(event_id AS VARCHAR) END AS text,
       {_ANGER} AS anger, {_K} AS disgust, ({_ANGER} + {_K}) / 2 AS negative, 1.0 - {_ANGER} AS joy
FROM events"""

ZONES = "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{z}')" for s, z in K.STATE_TZ) + ") z(state, tz)"

_ZONE_OF = "MAP {" + ", ".join(f"'{s}': '{z}'" for s, z in K.STATE_TZ) + "}"
_SPELT = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in K.STATE_ALIASES.items()) + "}"
# The hour by looking spelling and zone up in maps.
MSGS_LOCAL = f"""SELECT *, CAST(date_part('hour', timezone(ifnull({_ZONE_OF}[state], '{K.DEFAULT_ZONE}'), timezone('UTC', ts))) AS INTEGER)
       AS hour_local
FROM (SELECT * REPLACE (ifnull({_SPELT}[state], state) AS state) FROM ({MSGS}) q) m"""


def with_views(body: str, **views: str) -> str:
    """``WITH name AS (...), ... body``."""
    ctes = ",\n".join(f"{k} AS (\n{v}\n)" for k, v in views.items())
    return f"WITH {ctes}\n{body}"


# Election days are the Tuesdays of 2 to 8 November in even years; the next one is looked up
# per date. Season by month number, in quarters that start in December.
CALENDAR = f"""SELECT b.*, CAST(hour(created_at_et) AS INTEGER) AS hour_et, CAST(isodow(created_at_et) % 7 AS INTEGER) AS dow_et,
       CAST(month(created_at_et) AS INTEGER) AS month,
       ['Winter', 'Spring', 'Summer', 'Fall'][CAST(month(created_at_et) % 12 AS INTEGER) // 3 + 1] AS season,
       mod(b.year, 2) = 0 AS is_election_year, mod(b.year, 4) = 0 AS is_presidential, n.next_election,
       CAST(n.next_election - n.day AS INTEGER) AS days_to_election,
       1 - (n.next_election - n.day) / {K.DAYS_PER_CYCLE} AS cycle_phase
FROM (SELECT a.*, timezone('{K.DEFAULT_ZONE}', timezone('UTC', a.ts)) AS created_at_et FROM (@SRC@) a) b
JOIN (SELECT day, min(tuesday) AS next_election
      FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM (@SRC@) s) x,
           (SELECT CAST(d AS DATE) AS tuesday FROM range(DATE '1960-11-02', DATE '2100-11-09', INTERVAL 1 DAY) g(d)
            WHERE month(d) = 11 AND day(d) BETWEEN 2 AND 8 AND isodow(d) = 2 AND year(d) % 2 = 0) e
      WHERE tuesday >= day GROUP BY day) n ON n.day = CAST(b.ts AS DATE)"""

# In office: the day lies in one of the spans listed for the author; age in days over days a year.
D_POSTS_BODY = f"""SELECT c.* EXCLUDE (day), (c.day - c.birthday) / {K.DAYS_PER_YEAR} AS age_at_tweet
FROM (SELECT *, CAST(ts AS DATE) AS day FROM (@SRC@) s) c
JOIN (SELECT author, list({{'a': term_start, 'z': term_end}}) AS spans FROM (@TERMS@) t GROUP BY author) o USING (author)
WHERE len(list_filter(o.spans, lambda x: x.a <= c.day AND c.day <= x.z)) > 0"""



def _d_posts(src: str) -> str:
    return D_POSTS_BODY.replace("@SRC@", CALENDAR.replace("@SRC@", src)).replace("@TERMS@", TERMS)


D_POSTS = _d_posts(POSTS)
D_POSTS_TEXT = _d_posts(POSTS_TEXT)


def battery_sql(view: str, keys: list[str], min_n: int, where: str = "TRUE",
                means=("anger", "negative", "disgust", "joy", "optimism", "fear", "sadness"),
                within: list[str] | None = None, members: str | None = None, se: bool = True,
                share: bool = True, extra: str = "") -> str:
    """Oracle form of a mean battery, optionally with deviation within groups."""
    k = ", ".join(keys)
    cols = ["count(*) AS n"]
    if members:
        cols.append(f"count(DISTINCT {members}) AS members")
    for i, m in enumerate(means):
        cols.append(f"avg({m}) AS {m}")
        if i == 0 and share:
            cols.append("avg(CAST(anger > 0.5 AS INTEGER)) AS share_angry")
    if extra:
        cols.append(extra)
    if se:
        cols.append("stddev_samp(anger) / sqrt(count(*)) AS anger_se")
    inner = f"SELECT {k}, {', '.join(cols)} FROM {view} WHERE {where} GROUP BY {k} HAVING count(*) >= {min_n}"
    names = [c.rsplit(" AS ", 1)[1] for c in cols]
    ints = {"n", "members"}
    outs = [f"ROUND({c}, 6) AS {c}" if c not in ints else c for c in names]
    if within:
        w = ", ".join(within)
        outs.append(f"ROUND(anger - sum(anger * n) OVER (PARTITION BY {w}) / sum(n) OVER (PARTITION BY {w}), 6) AS anger_dev")
    return f"SELECT {k}, {', '.join(outs)} FROM ({inner}) cells"


def lexicon_sql(src: str, text: str = "text") -> str:
    """DuckDB twin of ``scoring.lexicon_scores`` over the rows of ``src``."""
    from ..operators.scoring import LEXICON, WEIGHTS

    t = (f"trim(regexp_replace(regexp_replace({text}, '@[\\p{{L}}\\p{{N}}_]+', '@user', 'g'), "
         f"'https?://\\S+', 'http', 'g'))")
    inner = (f"SELECT s.*, regexp_extract_all(lower(_t), '[a-z]+') AS _w, "
             f"ln(1 + (length(_t) - length(replace(_t, '!', '')))) AS _e, "
             f"length(regexp_replace(_t, '[^A-Z]', '', 'g')) / greatest(length(_t), 1) AS _c "
             f"FROM (SELECT x.*, {t} AS _t FROM ({src}) x) s")
    logits = {}
    for lab in list(K.EMOTIONS) + list(K.SENTIMENTS):
        words = ", ".join(f"'{w}'" for w in LEXICON[lab])
        b, wh, we, wc = WEIGHTS[lab]
        hits = f"CAST(len(list_filter(_w, lambda w: list_contains([{words}], w))) AS DOUBLE)"
        logits[lab] = f"({b} + {wh} * ln(1 + {hits}) + {we} * _e + {wc} * _c)"
    emo = ", ".join(f"1.0 / (1.0 + exp(-{logits[e]})) AS {e}" for e in K.EMOTIONS)
    m = f"greatest({', '.join(logits[s] for s in K.SENTIMENTS)})"
    den = " + ".join(f"exp({logits[s]} - {m})" for s in K.SENTIMENTS)
    sent = ", ".join(f"exp({logits[s]} - {m}) / ({den}) AS {s}" for s in K.SENTIMENTS)
    return f"SELECT * EXCLUDE (_t, _w, _e, _c), {emo}, {sent} FROM ({inner}) f"
