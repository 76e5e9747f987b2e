"""Interaction-network queries over ``msgs``."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import network as N
from . import oracle_views as O
from .registry import register
from .views import msgs

# The reference drops retweets of two collection-gap years; the test corpus spans one
# month, so no year is excluded here.
EXCLUDE_YEARS: list[int] = []
THRESHOLDS = [3, 4, 5]


def _base(spark, root):
    """The messages of grouped authors, the people and the alias table (all lazy)."""
    d = msgs(spark, root).filter(F.col("party").isNotNull())
    d = d.withColumn("angry", (F.col("anger") > K.ANGRY_THRESHOLD).cast("int"))
    return d, N.members(d), N.aliases(d)


def _edges(spark, root, min_n: int = K.MIN_EDGE):
    d, nodes, alias = _base(spark, root)
    rt = N.member_edges(N.retweet_edges(d, alias, exclude_years=EXCLUDE_YEARS), nodes, min_n=min_n)
    return nodes, rt, N.member_edges(N.dot_edges(d, alias), nodes, min_n=min_n)


def _degrees(spark, root):
    nodes, rt, dot = _edges(spark, root)
    return N.node_degrees(rt, dot, nodes)


# Oracle: one long table of mentions of both kinds, edges per kind, and degrees as filtered
# sums over a long table of edge ends.
NET = f"""
mentions AS (SELECT 'retweet' AS kind, author AS src, anger, lower(regexp_extract(text, '^RT @(\\w+)', 1)) AS h
             FROM d WHERE starts_with(text, 'RT @')
             UNION ALL
             SELECT 'dot', author, anger, lower(unnest(regexp_extract_all(text, '(?:^|\\s)\\.@(\\w+)', 1)))
             FROM d WHERE NOT starts_with(text, 'RT @')),
people AS (SELECT DISTINCT ON (author) author AS id, author_name, party, state,
                  count(*) OVER (PARTITION BY author) AS n_msgs FROM d ORDER BY author, ts DESC, msg_id DESC),
names AS (SELECT h, id FROM (SELECT lower(handle) AS h, author AS id FROM d) x GROUP BY ALL),
links AS (SELECT kind, src, id AS dst, count(*) AS n, avg(anger) AS anger FROM mentions JOIN names USING (h) GROUP BY ALL),
known AS (SELECT l.*, f.party AS sp, t.party AS dp, list_sort([f.party, t.party]) = ['Democrat', 'Republican'] AS is_cross
          FROM links l JOIN people f ON f.id = l.src JOIN people t ON t.id = l.dst WHERE l.src <> l.dst),
strong AS (SELECT * FROM known WHERE n >= {K.MIN_EDGE}),
sides AS (SELECT kind || '_in' AS side, dst AS id, n, anger, is_cross FROM strong
          UNION ALL SELECT kind || '_out', src, n, anger, is_cross FROM strong),
deg AS (SELECT id, regexp_replace(any_value(author_name), '\\s+[DRI]-[A-Z]{{2}}$', '') AS name,
               any_value(party) AS party, any_value(state) AS state,
               {', '.join(f"CAST(coalesce(sum(n) FILTER (side = '{k}_{e}'), 0) AS BIGINT) AS {c}_{e}"
                          for k, c in (('retweet', 'rt'), ('dot', 'dot')) for e in ('in', 'out'))},
               CAST(coalesce(sum(n) FILTER (side = 'retweet_in' AND is_cross), 0) AS BIGINT) AS cross_rt_in,
               CAST(coalesce(sum(n) FILTER (side = 'dot_in' AND is_cross), 0) AS BIGINT) AS cross_dot_in,
               sum(anger * n) FILTER (side = 'dot_in' AND is_cross) / sum(n) FILTER (side = 'dot_in' AND is_cross)
                 AS cross_dot_anger
        FROM sides LEFT JOIN people USING (id) GROUP BY id)"""


def _q(body: str) -> str:
    src = f"SELECT *, CAST(anger > 0.5 AS INTEGER) AS angry FROM ({O.MSGS}) x WHERE party IS NOT NULL"
    return O.with_views("", d=src).rstrip() + "," + NET + "\n" + body


_EDGE_COLS = "src, dst, n, ROUND(anger, 6) AS anger, sp, dp, is_cross"


@register("rt_edges", _q(f"SELECT {_EDGE_COLS} FROM strong WHERE kind = 'retweet'"))
def rt_edges(spark, root):
    """Member-to-member retweet edges with n >= 3 and the cross flag."""
    return _edges(spark, root)[1]


@register("dot_edges", _q(f"SELECT {_EDGE_COLS} FROM strong WHERE kind = 'dot'"))
def dot_edges(spark, root):
    """Call-out edges (every ``.@`` counts)."""
    return _edges(spark, root)[2]


@register("network_members", _q("SELECT id, author_name, party, state, n_msgs FROM people"))
def network_members(spark, root):
    """K1/E5: one row per person with latest attributes and message count."""
    return _base(spark, root)[1].select("id", "author_name", "party", "state", "n_msgs")


_DEG = "id, name, party, state, rt_in, rt_out, dot_in, dot_out, cross_rt_in, cross_dot_in, ROUND(cross_dot_anger, 6) AS cross_dot_anger"


@register("node_degree", _q(f"SELECT {_DEG} FROM deg"))
def node_degree(spark, root):
    """in/out degree per kind, cross in-degree, cross call-out score."""
    return _degrees(spark, root)


@register("bridges", _q(f"SELECT {_DEG} FROM deg ORDER BY cross_rt_in DESC, id LIMIT {K.TOP_BRIDGES}"))
def bridges(spark, root):
    """K8: the 12 nodes most retweeted across groups."""
    return N.top_nodes(_degrees(spark, root), "cross_rt_in")


@register("lightning_rods", _q(f"SELECT {_DEG} FROM deg ORDER BY cross_dot_in DESC, id LIMIT {K.TOP_BRIDGES}"))
def lightning_rods(spark, root):
    """K8: the 12 nodes most called out across groups."""
    return N.top_nodes(_degrees(spark, root), "cross_dot_in")


def _summary_sql(key: str, rows: str) -> str:
    """Summary per ``key`` of the edges in ``rows``."""
    return f"""SELECT {key}, count(*) AS edges, CAST(sum(n) AS BIGINT) AS messages,
       ROUND(count(*) FILTER (is_cross) / count(*), 6) AS cross_edge_share,
       ROUND(coalesce(sum(n) FILTER (is_cross), 0) / sum(n), 6) AS cross_msg_share,
       ROUND(sum(anger * n) FILTER (NOT is_cross) / sum(n) FILTER (NOT is_cross), 6) AS anger_same,
       ROUND(sum(anger * n) FILTER (is_cross) / sum(n) FILTER (is_cross), 6) AS anger_cross
FROM {rows} GROUP BY {key}"""


@register("net_summary", _q(_summary_sql("kind", "strong")))
def net_summary(spark, root):
    """K9: edges, messages, cross shares and n-weighted scores per edge kind."""
    _, rt, dot = _edges(spark, root)
    return (N.network_summary(rt).select(F.lit("retweet").alias("kind"), "*")
            .unionByName(N.network_summary(dot).select(F.lit("dot").alias("kind"), "*")))


@register("edge_thresholds", _q(_summary_sql("min_n", f"(SELECT k.*, m.min_n FROM known k, (SELECT unnest({THRESHOLDS}) AS min_n) m "
                                             "WHERE kind = 'retweet' AND n >= m.min_n) x")))
def edge_thresholds(spark, root):
    """The retweet summary at several minimum edge weights."""
    return N.threshold_summary(_edges(spark, root, min_n=min(THRESHOLDS))[1], THRESHOLDS)


@register("union_edges", _q("""SELECT least(src, dst) AS a, greatest(src, dst) AS b,
       ROUND(sum(ln(1 + n) * CASE kind WHEN 'retweet' THEN 1.0 ELSE 0.6 END), 6) AS weight FROM strong GROUP BY 1, 2"""))
def union_edges(spark, root):
    """Undirected union of both edge kinds, weight sum of w * ln(1 + n)."""
    _, rt, dot = _edges(spark, root)
    return N.union_weights(rt, dot)


@register("edge_buckets", _q("""SELECT CASE WHEN n >= 3 AND n < 6 THEN '[3,6)' WHEN n >= 6 AND n < 15 THEN '[6,15)'
       WHEN n >= 15 AND n < 50 THEN '[15,50)' WHEN n >= 50 THEN '[50,inf)' END AS bucket, count(*) AS edges
FROM strong WHERE kind = 'dot' GROUP BY 1"""))
def edge_buckets(spark, root):
    """Call-out edges per weight bucket."""
    return _edges(spark, root)[2].groupBy(N.edge_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("edges"))


@register("hub_ranking", _q("""SELECT party, rank, id, name, string_split_regex(trim(name), '\\s+')[-1] AS label, hub FROM (
  SELECT party, id, name, rt_in + 4 * dot_in AS hub,
         row_number() OVER (PARTITION BY party ORDER BY rt_in + 4 * dot_in DESC, id) AS rank FROM deg) h WHERE rank <= 3"""))
def hub_ranking(spark, root):
    """The top three hubs of each group by rt_in + 4 * dot_in."""
    return N.hubs(_degrees(spark, root))


@register("mention_kinds", _q(f"""SELECT kind, relation, count(*) AS n, ROUND(avg(angry), 6) AS share_angry FROM (
  SELECT ['reply', 'callout', 'mention'][list_position([regexp_matches(text, '^@\\w'), regexp_matches(text, '(?:^|\\s)\\.@\\w'),
                                                       regexp_matches(text, '@\\w')], true)] AS kind,
         CASE WHEN p.party = d.party THEN 'same' WHEN list_has_all(['Democrat', 'Republican'], [p.party, d.party]) THEN 'cross'
              ELSE 'other' END AS relation, angry
  FROM d JOIN names ON names.h = lower(regexp_extract(text, '@(\\w+)', 1)) JOIN people p ON p.id = names.id
  WHERE NOT starts_with(text, 'RT @')) x WHERE kind IS NOT NULL GROUP BY ALL"""))
def mention_kinds(spark, root):
    """Reply / call-out / mention x same / cross group, share of angry messages."""
    d, nodes, alias = _base(spark, root)
    return N.mention_kinds(d, alias, nodes)


@register("degree_sizes", _q("SELECT id, rt_in, ROUND(sqrt(rt_in) / sqrt(max(rt_in) OVER ()), 6) AS size FROM deg"))
def degree_sizes(spark, root):
    """node sizes -- the square root of the degree over that of the largest."""
    return N.scaled_degrees(_degrees(spark, root)).select("id", "rt_in", "size")


@register("rt_share", O.with_views("""SELECT year, count(*) AS n, ROUND(avg(CAST(regexp_matches(text, '^RT @') AS INTEGER)), 6)
       AS rt_share FROM m GROUP BY year""", m=O.MSGS))
def rt_share(spark, root):
    """Share of retweets by year (collection-gap check)."""
    return msgs(spark, root).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("text").rlike(K.RETWEET_PREFIX).cast("int")).alias("rt_share"))


@register("cross_edges", _q(f"SELECT kind, {_EDGE_COLS} FROM strong WHERE is_cross"))
def cross_edges(spark, root):
    """K6: the edges joining the two main groups, both kinds."""
    _, rt, dot = _edges(spark, root)
    return (rt.filter("is_cross").select(F.lit("retweet").alias("kind"), "*")
            .unionByName(dot.filter("is_cross").select(F.lit("dot").alias("kind"), "*")))
