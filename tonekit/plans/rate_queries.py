"""Forecast family over ``msgs``: cells, leaderboards, night owls, ladder, lookup."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import calendar as cal
from ..operators import rates as R
from . import oracle_views as O
from .registry import register
from .views import local_msgs

MIN_CELL = 30
MIN_MEMBER_CELL = 10
MIN_NIGHT = 10
LOOKUP_BAND = "00-04 night"


def forecast_view(spark, root):
    m = local_msgs(spark, root)
    return (m.withColumn("angry", (F.col("anger") > K.ANGRY_THRESHOLD).cast("int"))
             .withColumn("band", cal.hour_band("hour_local"))
             .withColumn("era", cal.era("ts")))


def forecast_cells(spark, root):
    """The messages counted once per author, attributes, era and band."""
    return R.message_cells(forecast_view(spark, root))


def _names(cells):
    """Per author the latest display name, group and state."""
    return R.latest_from_cells(cells).select("author", F.col("author_name").alias("name"), "party", "state")


# Oracle: era and band by position in a list, the newest message of each author names them.
_BANDS = [next((lab for lo, hi, lab in K.HOUR_BANDS if lo <= h <= hi), K.HOUR_BAND_ELSE) for h in range(24)]
_CUTS = "[" + ", ".join(f"TIMESTAMP '{c}'" for c, _ in K.ERA_CUTS) + "]"
FORECAST = f"""SELECT m.*, CASE WHEN anger > 0.5 THEN 1 ELSE 0 END AS angry, {_BANDS}[hour_local + 1] AS band,
       {[lab for _, lab in K.ERA_CUTS] + [K.ERA_LAST]}[1 + len(list_filter({_CUTS}, lambda c: c <= m.ts))] AS era
FROM ({O.MSGS_LOCAL}) m"""
WHO = """SELECT DISTINCT ON (author) author, author_name AS name, party AS latest_party, state AS latest_state FROM f
ORDER BY author, ts DESC, msg_id DESC"""
PER_AUTHOR = """SELECT f.* EXCLUDE (author_name, party, state), w.* EXCLUDE (author) FROM f JOIN who w ON w.author = f.author"""


def _f(body: str) -> str:
    return O.with_views(body, f=FORECAST, who=WHO, na=PER_AUTHOR)


@register("rate_cells", _f(f"""SELECT party, era, band, count(*) AS n, ROUND(sum(angry) / count(*), 6) AS share_angry
FROM f SEMI JOIN (VALUES ('Democrat'), ('Republican')) g(party) USING (party) GROUP BY ALL HAVING n >= {MIN_CELL}"""))
def rate_cells(spark, root):
    """Era x group x hour band, share of angry messages."""
    return R.rate_cells(forecast_view(spark, root), ["era", "party", "band"], min_n=MIN_CELL,
                        where=F.col("party").isin(*K.MAIN_GROUPS))


@register("author_leaderboard", _f(f"""SELECT author, name, latest_party AS party, latest_state AS state, count(*) AS n,
       ROUND(sum(angry) / count(*), 6) AS share_angry, ROUND(avg(anger), 6) AS mean_anger
FROM na GROUP BY ALL HAVING n >= {MIN_CELL}"""))
def author_leaderboard(spark, root):
    """Per author (latest name/group/state), share and mean, n >= floor."""
    cells = forecast_cells(spark, root)
    per = R.pooled(cells, ["author"], MIN_CELL, mean="mean_anger").join(_names(cells), "author")
    return per.select("author", "name", "party", "state", "n", "share_angry", "mean_anger").orderBy(
        F.desc("share_angry"), "author")


@register("author_cells", _f(f"""SELECT author, name, latest_party AS party, era, band, count(*) AS n,
       ROUND(sum(angry) / count(*), 6) AS share_angry FROM na GROUP BY author, name, latest_party, era, band
HAVING n >= {MIN_MEMBER_CELL}"""))
def author_cells(spark, root):
    """Author x era x band cells."""
    cells = forecast_cells(spark, root)
    per = R.pooled(cells, ["author", "era", "band"], MIN_MEMBER_CELL).join(_names(cells), "author")
    return per.select("author", "name", "party", "era", "band", "n", "share_angry")


@register("night_day_contrast", _f(f"""SELECT author, name, latest_party AS party, count(*) AS n,
       count(*) FILTER (dark) AS n_night, ROUND(avg(angry) FILTER (band = '09-17 work'), 6) AS daytime,
       ROUND(avg(angry) FILTER (dark), 6) AS nighttime,
       ROUND(avg(angry) FILTER (dark) - avg(angry) FILTER (band = '09-17 work'), 6) AS night_minus_day
FROM (SELECT *, hour_local >= 21 OR hour_local <= 4 AS dark FROM na) x GROUP BY author, name, latest_party
HAVING n_night >= {MIN_NIGHT}"""))
def night_day_contrast(spark, root):
    """Night owls -- late-hour share minus working-hours share, per author."""
    cells = forecast_cells(spark, root)
    return R.night_day(cells, "author", min_night=MIN_NIGHT).join(_names(cells), "author").select(
        "author", "name", "party", "n", "n_night", "daytime", "nighttime", "night_minus_day")


def _step(**known) -> tuple:
    """(label, party, era, band, name): what is known at a step, None for anything; the label lists it."""
    label = "; ".join(f"{c} is {v}" for c, v in known.items()) or "nothing"
    return (label, *(known.get(c) for c in ("party", "era", "band", "name")))


_ERA, _GROUP = K.ERA_CUTS[-1][1], K.MAIN_GROUPS[0]
STEPS = [_step(), _step(band=K.NIGHT_BANDS[1]), _step(party=_GROUP), _step(party=_GROUP, era=_ERA),
         *[_step(party=_GROUP, era=_ERA, band=b) for b in (K.DAY_BAND, K.NIGHT_BANDS[1])],
         _step(name="User 4", era=_ERA, band=K.DAY_BAND)]
_STEP_ROWS = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in s) + ")" for s in STEPS)


@register("info_ladder", _f(f"""SELECT s.known, ROUND(avg(x.angry), 6) AS p
FROM (VALUES {_STEP_ROWS}) s(known, party, era, band, name)
LEFT JOIN (SELECT f.*, w.name FROM f JOIN who w USING (author)) x
  ON coalesce(s.party = x.party, s.party IS NULL) AND coalesce(s.era = x.era, s.era IS NULL)
 AND coalesce(s.band = x.band, s.band IS NULL) AND coalesce(s.name = x.name, s.name IS NULL) GROUP BY s.known"""))
def info_ladder(spark, root):
    """The information ladder in one pass, baseline first then by p."""
    cells = forecast_cells(spark, root)
    cells = cells.join(_names(cells).select("author", "name"), "author")

    def known(step):
        cond = F.lit(True)
        for c, v in zip(("party", "era", "band", "name"), step[1:]):
            cond = cond if v is None else cond & (F.col(c) == v)
        return cond

    return R.ladder_order(R.ladder(cells, [(s[0], known(s)) for s in STEPS]))


def _lookup_inputs(spark, root):
    cells = forecast_cells(spark, root)
    names = _names(cells)
    by_group = R.pooled(cells.filter(F.col("party").isin(*K.MAIN_GROUPS)), ["party", "era", "band"], MIN_CELL)
    by_member = R.pooled(cells.join(names.select("author", "name"), "author"), ["name", "era", "band"], MIN_MEMBER_CELL)
    unknown = F.lit(None).cast("string")
    asked = names.select(F.concat(F.lit("m"), F.col("author").cast("string")).alias("req"), "party",
                         unknown.alias("era"), F.lit(LOOKUP_BAND).alias("band"), "name")
    general = names.select(F.concat(F.lit("g"), F.col("author").cast("string")).alias("req"), "party",
                           unknown.alias("era"), unknown.alias("band"), unknown.alias("name"))
    return asked.unionByName(general), by_group, by_member


def _sql_list(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


_LOOKUP_SQL = _f(f"""
, gcell AS (SELECT party, era, band, sum(angry) AS k, count(*) AS n FROM f WHERE party IN ('Democrat', 'Republican')
            GROUP BY ALL HAVING n >= {MIN_CELL}),
mcell AS (SELECT name, era, band, sum(angry) AS k, count(*) AS n FROM na GROUP BY ALL HAVING n >= {MIN_MEMBER_CELL}),
asks AS (SELECT kind || CAST(author AS VARCHAR) AS req, latest_party AS party, CAST(NULL AS VARCHAR) AS era,
                CASE kind WHEN 'm' THEN '{LOOKUP_BAND}' END AS band, CASE kind WHEN 'm' THEN name END AS name
         FROM who, (VALUES ('m'), ('g')) t(kind)),
mans AS (SELECT req, sum(k) / sum(n) AS p, sum(n) AS n FROM asks a JOIN mcell c
         ON c.name = a.name AND coalesce(c.era = a.era, a.era IS NULL) AND coalesce(c.band = a.band, a.band IS NULL) GROUP BY 1),
gans AS (SELECT req, sum(k) / sum(n) AS p, sum(n) AS n FROM asks a JOIN gcell c
         ON coalesce(c.party = a.party, a.party IS NULL) AND coalesce(c.era = a.era, a.era IS NULL)
        AND coalesce(c.band = a.band, a.band IS NULL) GROUP BY 1),
ans AS (SELECT a.*, m.req IS NOT NULL AS by_member, g.req IS NOT NULL AS by_group, coalesce(m.p, g.p) AS p,
               CAST(coalesce(m.n, g.n, 0) AS BIGINT) AS n
        FROM asks a LEFT JOIN mans m USING (req) LEFT JOIN gans g USING (req))
SELECT req, party, era, band, name, ROUND(p, 6) AS p, n,
       CASE WHEN by_member THEN concat(name, ' during ' || era, ', ' || band)
            WHEN NOT by_group THEN '{K.NO_DATA}' WHEN party IS NULL AND era IS NULL AND band IS NULL THEN '{K.NOTHING_KNOWN}'
            ELSE array_to_string(list_filter(['a ' || party, 'during ' || era, 'at ' || band], lambda x: x IS NOT NULL), ', ')
       END AS description,
       {_sql_list([*K.VERDICT_TEXTS, K.VERDICT_ELSE])}[coalesce(list_position([p >= 0.75, p >= 0.5, p < 0.25], true), 4)] AS verdict,
       CAST(CAST(round(p * 100) AS BIGINT) AS VARCHAR) || '%' AS p_text
FROM ans""").replace(")\n\n, gcell", "),\ngcell")


@register("rate_lookup", _LOOKUP_SQL)
def rate_lookup(spark, root):
    """Batch lookup -- one answer per request row, member cells first."""
    req, cells, mcells = _lookup_inputs(spark, root)
    return R.rate_lookup(req, cells, mcells)


_STATED = "FROM na WHERE name = 'User 4' AND era = 'Biden' AND hour_local <= 8"


def _stated(spark, root):
    ids = _names(forecast_cells(spark, root)).filter(F.col("name") == "User 4")
    return R.statement(forecast_view(spark, root), ids, ["00-04 night", "05-08 morning"], "Biden")


@register("statement_card", _f(f"""SELECT ROUND(avg(angry), 6) AS p, count(*) AS n, CAST(min(ts) AS DATE) AS "from",
       CAST(max(ts) AS DATE) AS "to" {_STATED}"""))
def statement_card(spark, root):
    """The statement summary for one author, hour range and era."""
    return _stated(spark, root)[0]


@register("statement_messages", _f(f"SELECT ts AS t, angry AS a, text AS x {_STATED}"))
def statement_messages(spark, root):
    """The statement's messages in time order (rows, not a collected list)."""
    return _stated(spark, root)[1]


@register("calmest_authors", _f(f"""SELECT author, name, latest_party AS party, count(*) AS n,
       ROUND(sum(angry) / count(*), 6) AS share_angry FROM na GROUP BY author, name, latest_party HAVING n >= {MIN_CELL}
ORDER BY sum(angry) / count(*), author LIMIT 8"""))
def calmest_authors(spark, root):
    """F12 (bottom-k): the eight authors with the lowest angry share, lowest first."""
    cells = forecast_cells(spark, root)
    low = R.pooled(cells, ["author"], MIN_CELL).orderBy("share_angry", "author").limit(8)
    return low.join(_names(cells), "author").select("author", "name", "party", "n", "share_angry")
