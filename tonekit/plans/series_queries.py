"""Weekly seismograph and other series queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import calendar as cal
from ..functions import text as T
from ..operators import battery as B
from ..operators import series as S
from ..operators import terms as TM
from ..session import materialize
from ..sources.files import read_table
from . import oracle_views as O
from .registry import register
from .views import analysis_posts, msgs, numbered_documents, winners_with_text

MIN_WEEK = 20   # weekly floor at test scale (500 on the full corpus)
MIN_TERM = 3    # distinctive-term floor at test scale (15 on the full corpus)
MIN_N = 30
EXTRA_MEANS = ["disgust", "fear", "sadness", "joy"]

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(K.STOP_WORDS)))
_TOKENS = (r"list_distinct(list_filter(regexp_extract_all(regexp_replace(lower(text), 'https?://\S+|@[\p{L}\p{N}_]+', ' ', 'g'), "
           r"'#?[a-z][a-z''’\-]{2,}'), lambda w: NOT list_contains([" + _STOP + "], ltrim(w, '#'))))")

SERIES_SQL = f"""
w0 AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS wk, count(*) AS n, avg(anger) AS anger,
              avg(CAST(anger > 0.5 AS INTEGER)) AS share_angry,
              avg(CASE WHEN party = 'Democrat' THEN anger END) AS anger_dem,
              avg(CASE WHEN party = 'Republican' THEN anger END) AS anger_rep,
              CAST(sum(CASE WHEN party = 'Democrat' THEN 1 ELSE 0 END) AS BIGINT) AS n_dem,
              CAST(sum(CASE WHEN party = 'Republican' THEN 1 ELSE 0 END) AS BIGINT) AS n_rep,
              {', '.join(f"avg({c}) AS {c}" for c in EXTRA_MEANS)}
       FROM d GROUP BY 1 HAVING count(*) >= {MIN_WEEK}),
w1 AS (SELECT *, CASE WHEN count(anger) OVER w13 >= 5 THEN median(anger) OVER w13 END AS baseline,
              CASE WHEN count(anger_dem) OVER w13 >= 5 THEN median(anger_dem) OVER w13 END AS base_dem,
              CASE WHEN count(anger_rep) OVER w13 >= 5 THEN median(anger_rep) OVER w13 END AS base_rep
       FROM w0 WINDOW w13 AS (ORDER BY wk ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
w2 AS (SELECT *, anger - baseline AS excess, anger_dem - base_dem AS dem_excess, anger_rep - base_rep AS rep_excess FROM w1),
w3 AS (SELECT *, excess / nullif(CASE WHEN count(excess) OVER w52 >= 20 THEN stddev_samp(excess) OVER w52 END, 0) AS spike_score
       FROM w2 WINDOW w52 AS (ORDER BY wk ROWS BETWEEN 26 PRECEDING AND 25 FOLLOWING)),
picked AS (SELECT unnest(list_reduce(c, lambda acc, x: CASE WHEN len(acc) < {K.TOP_SPIKES}
                   AND len(list_filter(acc, lambda a: abs(date_diff('day', a, x.p)) < {K.MIN_GAP_DAYS})) = 0
                   THEN list_append(acc, x.p) ELSE acc END, CAST([] AS DATE[]))) AS wk
           FROM (SELECT list(struct_pack(neg := -excess, p := wk) ORDER BY -excess, wk) AS c FROM w3 WHERE excess IS NOT NULL)),
peaks AS (SELECT w3.* FROM w3 JOIN picked USING (wk))"""


def _series(body: str) -> str:
    return O.with_views(SERIES_SQL + "\n" + body, d=O.D_POSTS_TEXT).replace(")\n\nw0 AS", "),\nw0 AS")


def _series_posts(spark, root):
    return S.baseline_and_spikes(S.weekly_series(analysis_posts(spark, root), min_n=MIN_WEEK, extra_means=EXTRA_MEANS))


@register("weekly_series", _series("""SELECT wk, n, ROUND(anger, 6) AS anger, ROUND(share_angry, 6) AS share_angry,
       ROUND(anger_dem, 6) AS anger_dem, ROUND(anger_rep, 6) AS anger_rep, n_dem, n_rep,
       """ + ", ".join(f"ROUND({c}, 6) AS {c}" for c in (*EXTRA_MEANS, "baseline", "excess", "spike_score", "dem_excess",
                                                        "rep_excess")) + " FROM w3"))
def weekly_series(spark, root):
    """The weekly battery with per-group means and counts, the extra means and the
    baseline columns, thin weeks dropped."""
    return _series_posts(spark, root)


@register("rolling_baseline", _series("""SELECT wk, n, ROUND(anger, 6) AS anger, ROUND(baseline, 6) AS baseline,
       ROUND(excess, 6) AS excess, ROUND(spike_score, 6) AS spike_score, ROUND(dem_excess, 6) AS dem_excess,
       ROUND(rep_excess, 6) AS rep_excess, ROUND(greatest(anger, baseline), 6) AS upper FROM w3"""))
def rolling_baseline(spark, root):
    """Centred rolling median baseline, excess, spike score, group excess."""
    return _series_posts(spark, root).select("wk", "n", "anger", "baseline", "excess", "spike_score",
                                             "dem_excess", "rep_excess", S.upper_band().alias("upper"))


@register("spikes_greedy", _series("""SELECT wk, n, ROUND(anger, 6) AS anger, ROUND(baseline, 6) AS baseline,
       ROUND(excess, 6) AS excess, ROUND(spike_score, 6) AS spike_score FROM peaks"""))
def spikes_greedy(spark, root):
    """greedy peak picking, 40 peaks at least 21 days apart."""
    return S.greedy_peaks(_series_posts(spark, root)).select("wk", "n", "anger", "baseline", "excess", "spike_score")


_TERMS_SQL = f"""
, tok AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS wk, {_TOKENS} AS t FROM d WHERE anger > 0.5),
win AS (SELECT p.wk AS peak, p.wk + CAST(o * 7 AS INTEGER) AS wk, o = 0 AS in_peak
        FROM peaks p, range(-6, 8) r(o)),
sizes AS (SELECT peak, greatest(1, sum(CASE WHEN in_peak THEN 1 ELSE 0 END)) AS nw,
                 greatest(1, sum(CASE WHEN NOT in_peak THEN 1 ELSE 0 END)) AS nb
          FROM tok JOIN win USING (wk) GROUP BY peak),
cnt AS (SELECT peak, token, sum(CASE WHEN in_peak THEN 1 ELSE 0 END) AS cw, sum(CASE WHEN NOT in_peak THEN 1 ELSE 0 END) AS cb
        FROM (SELECT wk, unnest(t) AS token FROM tok) x JOIN win USING (wk) GROUP BY peak, token),
sc AS (SELECT c.peak, c.token, starts_with(c.token, '#') AS is_tag,
              ln((cw + 1) / nw) - ln((cb + 1) / nb) AS score
       FROM cnt c JOIN sizes s USING (peak) WHERE cw >= {MIN_TERM}),
rk AS (SELECT *, row_number() OVER (PARTITION BY peak, is_tag ORDER BY round(score, 9) DESC, token) AS r FROM sc),
kw AS (SELECT peak, string_agg(token, ' ' ORDER BY r) AS keywords FROM rk WHERE NOT is_tag AND r <= {K.TOP_WORDS} GROUP BY peak),
ht AS (SELECT peak, string_agg(token, ' ' ORDER BY r) AS hashtags FROM rk WHERE is_tag AND r <= {K.TOP_TAGS} GROUP BY peak),
terms AS (SELECT p.wk, coalesce(kw.keywords, '') AS keywords, coalesce(ht.hashtags, '') AS hashtags
          FROM peaks p LEFT JOIN kw ON kw.peak = p.wk LEFT JOIN ht ON ht.peak = p.wk),
msgwin AS (SELECT w.peak, w.in_peak, d.party, d.anger, d.msg_id
           FROM d JOIN win w ON w.wk = CAST(date_trunc('week', d.ts) AS DATE)),
drv AS (SELECT peak AS wk,
               avg(CASE WHEN party = 'Democrat' AND in_peak THEN anger END)
                 - avg(CASE WHEN party = 'Democrat' AND NOT in_peak THEN anger END) AS dem_excess,
               avg(CASE WHEN party = 'Republican' AND in_peak THEN anger END)
                 - avg(CASE WHEN party = 'Republican' AND NOT in_peak THEN anger END) AS rep_excess,
               arg_max(msg_id, CASE WHEN in_peak THEN (anger, -msg_id) END) AS ex_id
        FROM msgwin GROUP BY peak),
drivers AS (SELECT v.wk, v.dem_excess, v.rep_excess,
                   CASE WHEN v.dem_excess > v.rep_excess + {K.DRIVER_MARGIN} THEN 'Dem'
                        WHEN v.rep_excess > v.dem_excess + {K.DRIVER_MARGIN} THEN 'Rep' ELSE 'both' END AS driven_by,
                   c.c_name AS example_author,
                   substr(replace(t.text, chr(10), ' '), 1, {K.EXAMPLE_CHARS}) AS example
            FROM drv v LEFT JOIN orders o ON o.o_orderkey = v.ex_id LEFT JOIN customer c ON c.c_custkey = o.o_custkey
            LEFT JOIN ({O.NUMBERED}) t ON t.k = v.ex_id % (SELECT count(*) FROM documents))"""


def _peaks(spark, root):
    """The peak weeks, K.TOP_SPIKES at most: kept once, the branches of a report read them."""
    series = S.baseline_and_spikes(S.weekly_series(analysis_posts(spark, root), min_n=MIN_WEEK))
    return materialize(S.greedy_peaks(series).select("wk"))


def _with_example(spark, root, drivers):
    """Author and one-line text of each peak's example."""
    out = winners_with_text(spark, root, drivers, "example_id")  # a row a peak
    return (out.withColumn("example_author", F.col("author_name")).withColumn("example", T.one_line("text"))
            .drop("example_id", "author_name", "text"))


def week_events(spark, root):
    """Labels for every eighth week from 1995 on, made from the nations; other weeks have none."""
    n = read_table(spark, root, "nation", ["n_nationkey", "n_name"])
    return n.select(F.date_add(F.lit("1995-01-02").cast("date"), (56 * F.col("n_nationkey")).cast("int")).alias("wk"),
                    F.col("n_name").alias("event"))


def _posts_and_tokens(spark, root):
    """The posts with their documents' numbers, and where their tokens are, for TM.weeks_of."""
    docs, n_docs = numbered_documents(spark, root)
    posts = analysis_posts(spark, root).withColumn("_doc", F.pmod(F.col("msg_id"), F.lit(n_docs)))
    return posts, {"key": "_doc", "token_table": docs.select("_doc", T.tokens("text").alias("tokens"))}


@register("spike_terms", _series(_TERMS_SQL + "\nSELECT wk, keywords, hashtags FROM terms"))
def spike_terms(spark, root):
    """Distinctive words and tags of each peak week. The posts are read once, and counted per
    week and document before those meet their tokens."""
    posts, texts = _posts_and_tokens(spark, root)
    weeks = TM.weeks_of(posts, **texts)
    series = S.baseline_and_spikes(TM.week_means(weeks.groups, min_n=MIN_WEEK))
    return TM.terms_of_counts(weeks.tokens, materialize(S.greedy_peaks(series).select("wk")), min_count=MIN_TERM)


@register("driver_attribution", _series(_TERMS_SQL + """
SELECT wk, ROUND(dem_excess, 6) AS dem_excess, ROUND(rep_excess, 6) AS rep_excess, driven_by, example_author, example
FROM drivers"""))
def driver_attribution(spark, root):
    """Which group drove each peak, and the peak week's top example."""
    return _with_example(spark, root, TM.peak_drivers(analysis_posts(spark, root), _peaks(spark, root)))


@register("seismograph", _series(_TERMS_SQL + """
SELECT p.wk, p.n, ROUND(p.anger, 6) AS anger, ROUND(p.baseline, 6) AS baseline, ROUND(p.excess, 6) AS excess,
       ROUND(p.spike_score, 6) AS spike_score, t.keywords, t.hashtags, ROUND(r.dem_excess, 6) AS dem_excess,
       ROUND(r.rep_excess, 6) AS rep_excess, r.driven_by, r.example_author, r.example, coalesce(e.event, '') AS event
FROM peaks p LEFT JOIN terms t USING (wk) LEFT JOIN drivers r USING (wk)
LEFT JOIN (SELECT DATE '1995-01-02' + CAST(56 * n_nationkey AS INTEGER) AS wk, n_name AS event FROM nation) e USING (wk)"""))
def seismograph(spark, root):
    """The full spike table."""
    posts, texts = _posts_and_tokens(spark, root)
    report = TM.spike_report(posts, min_week_n=MIN_WEEK, min_count=MIN_TERM, labels=week_events(spark, root), **texts)
    return _with_example(spark, root, report)


@register("moving_mean", O.with_views("""SELECT mo, n, ROUND(anger, 6) AS anger,
       ROUND(avg(anger) OVER (ORDER BY mo ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth
FROM (SELECT CAST(date_trunc('month', ts) AS DATE) AS mo, count(*) AS n, avg(anger) AS anger FROM d GROUP BY 1) m""",
                                       d=O.D_POSTS))
def moving_mean(spark, root):
    """Monthly mean and its centred +-2 month moving mean."""
    m = analysis_posts(spark, root).groupBy(cal.month_start("ts").alias("mo")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("anger").alias("anger"))
    return m.withColumn("smooth", S.moving_mean("anger", order="mo"))


_MONTH_CELLS = f"""SELECT year, month, n, anger,
       anger - sum(anger * n) OVER (PARTITION BY year) / sum(n) OVER (PARTITION BY year) AS anger_dev
FROM (SELECT year, month, count(*) AS n, avg(anger) AS anger FROM d GROUP BY 1, 2 HAVING count(*) >= {MIN_N}) c"""


def _month_cells(spark, root):
    cells = B.mean_battery(analysis_posts(spark, root), ["year", "month"], means=("anger",), share_of=None,
                           se_of=None, min_n=MIN_N)
    return B.deviation_within(cells, "year")


@register("argmax_month", O.with_views(f"""SELECT year, month, ROUND(anger_dev, 6) AS anger_dev FROM (
  SELECT *, row_number() OVER (PARTITION BY year ORDER BY anger_dev DESC, month) AS rn FROM ({_MONTH_CELLS}) x) y
WHERE rn = 1""", d=O.D_POSTS))
def argmax_month(spark, root):
    """F8: the month with the largest deviation in each year."""
    return B.argmax_per_group(_month_cells(spark, root), "year", "anger_dev", ["month"])


@register("sign_consistency", O.with_views(f"""SELECT month, count(*) AS groups, CAST(count_if(anger_dev > 0) AS BIGINT) AS above,
       CAST(count_if(anger_dev < 0) AS BIGINT) AS below FROM ({_MONTH_CELLS}) x GROUP BY month""", d=O.D_POSTS))
def sign_consistency(spark, root):
    """in how many years each month sits above / below its year mean."""
    return B.sign_consistency(_month_cells(spark, root), ["month"])


@register("scaled_curve", O.with_views(f"""SELECT month, ROUND(dev, 6) AS dev, ROUND(dev / nullif(max(abs(dev)) OVER (), 0), 6) AS scaled
FROM (SELECT month, sum(anger_dev * n) / sum(n) AS dev FROM ({_MONTH_CELLS}) x GROUP BY month) y""", d=O.D_POSTS))
def scaled_curve(spark, root):
    """N-weighted mean deviation curve over years, scaled by its max |value|."""
    cells = _month_cells(spark, root)
    curve = cells.groupBy("month").agg((F.sum(F.col("anger_dev") * F.col("n")) / F.sum("n")).alias("dev"))
    return curve.withColumn("scaled", S.scale_by_max("dev"))


@register("running_share", O.with_views("""SELECT msg_id, author, ts,
       count(*) OVER w AS running_n, CAST(sum(angry) OVER w AS BIGINT) AS running_flagged, ROUND(avg(angry) OVER w, 6) AS running_share
FROM (SELECT msg_id, author, ts, CAST(anger > 0.5 AS INTEGER) AS angry FROM m) x
WINDOW w AS (PARTITION BY author ORDER BY ts, msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", m=O.MSGS))
def running_share(spark, root):
    """per author, running count and share of angry messages in time order."""
    m = msgs(spark, root).select("msg_id", "author", "ts", (F.col("anger") > 0.5).cast("int").alias("angry"))
    out = S.running_totals(m, ["author"], "angry", bucket="day")
    return out.select("msg_id", "author", "ts", "running_n", "running_flagged", "running_share")
