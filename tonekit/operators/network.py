"""Interaction networks from message text.

Edges come from handles found in the text (retweet prefix, ``.@`` call-outs). They are
counted per (source, handle) first -- a hub with millions of mentions costs one partial
row per source and task -- and only the counts are resolved through the alias table
(handle -> person).  Node tables are built by ``groupBy`` on the edge lists;
nothing is collected.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as TX
from .rates import latest


def members(df: DataFrame, person: str = "author", attrs: Sequence[str] = ("author_name", "party", "state"),
            ts: str = "ts", tie: str = "msg_id") -> DataFrame:
    """K1: one row per person -- latest non-NULL attributes and the message count."""
    per = latest(df, person, attrs, ts, tie, sums=[F.count(F.lit(1)).alias("n_msgs")], totals=[F.sum("n_msgs").alias("n_msgs")])
    return per.withColumnRenamed(person, "id")


def aliases(df: DataFrame, handle: str = "handle", person: str = "author") -> DataFrame:
    """Distinct (lower-cased handle, person) pairs."""
    return df.select(F.lower(F.col(handle)).alias("h"), F.col(person).alias("id")).distinct()


def retweet_edges(df: DataFrame, alias: DataFrame, person: str = "author", text: str = "text",
                  score: str = "anger", year: str = "year", exclude_years: Sequence[int] = K.SPARSE_RETWEET_YEARS
                  ) -> DataFrame:
    """``^RT @handle`` -> (src, dst, n, mean score); sparse years excluded."""
    rt = df.filter(TX.is_retweet(text))
    if exclude_years:
        rt = rt.filter(~F.col(year).isin(*exclude_years))
    rt = rt.select(F.col(person).alias("src"), F.col(score).alias("_s"),
                   F.lower(TX.rx_group(text, K.RETWEET_TARGET)).alias("h"))
    return _resolved(rt, alias, score)


def dot_edges(df: DataFrame, alias: DataFrame, person: str = "author", text: str = "text",
              score: str = "anger") -> DataFrame:
    """Every ``.@handle`` in a non-retweet is one edge message (a message
    calling out two members adds to two edges, and twice to one edge if repeated)."""
    m = df.filter(~TX.is_retweet(text)).select(
        F.col(person).alias("src"), F.col(score).alias("_s"),
        F.explode(TX.rx_all(text, K.DOT_MENTION)).alias("h"))
    return _resolved(m.withColumn("h", F.lower("h")), alias, score)


def _resolved(mentions: DataFrame, alias: DataFrame, score: str) -> DataFrame:
    """Mentions (src, h, _s) counted per (src, handle) first, so the alias join sees one row a
    pair and not the messages of a viral handle; then summed per person."""
    per = mentions.groupBy("src", "h").agg(F.count(F.lit(1)).alias("n"), F.count("_s").alias("_k"), F.sum("_s").alias("_t"))
    return per.join(alias, "h").groupBy("src", F.col("id").alias("dst")).agg(
        F.sum("n").alias("n"), F.try_divide(F.sum("_t"), F.sum("_k")).alias(score))


def member_edges(edges: DataFrame, nodes: DataFrame, min_n: int = K.MIN_EDGE, group: str = "party",
                 main=K.MAIN_GROUPS) -> DataFrame:
    """No self-loops, ``n >= min_n``, both endpoints known members, the
    endpoint groups attached and the cross-group flag (both in the two main groups
    and different)."""
    a = nodes.select(F.col("id").alias("src"), F.col(group).alias("sp"))
    b = nodes.select(F.col("id").alias("dst"), F.col(group).alias("dp"))
    e = edges.filter((F.col("src") != F.col("dst")) & (F.col("n") >= min_n))
    e = e.join(a, "src").join(b, "dst")
    cross = (F.col("sp") != F.col("dp")) & F.col("sp").isin(*main) & F.col("dp").isin(*main)
    return e.withColumn("is_cross", F.coalesce(cross, F.lit(False))).select("src", "dst", "n", "anger", "sp", "dp", "is_cross")


def node_degrees(rt: DataFrame, dot: DataFrame, nodes: DataFrame, score: str = "anger") -> DataFrame:
    """K7/L3: weighted in/out degree per edge kind, cross-group in-degree and the
    n-weighted score of cross call-outs received, for every node on either edge list.

    Each edge contributes one row to its target ("in") and one to its source ("out");
    the two kinds are unioned and reduced by ONE grouped aggregate with conditional
    sums -- no join between per-degree tables."""
    def sides(e, kind):
        cols = [F.col("n"), F.col(score).alias("_s"), F.col("is_cross")]
        return (e.select(F.col("dst").alias("id"), F.lit(kind).alias("_k"), F.lit("in").alias("_d"), *cols)
                 .unionByName(e.select(F.col("src").alias("id"), F.lit(kind).alias("_k"), F.lit("out").alias("_d"), *cols)))

    u = sides(rt, "rt").unionByName(sides(dot, "dot"))

    def total(kind, side, cross=False, value=None):
        cond = (F.col("_k") == kind) & (F.col("_d") == side)
        if cross:
            cond = cond & F.col("is_cross")
        return F.sum(F.when(cond, value if value is not None else F.col("n")))

    deg = u.groupBy("id").agg(
        F.coalesce(total("rt", "in"), F.lit(0)).alias("rt_in"), F.coalesce(total("rt", "out"), F.lit(0)).alias("rt_out"),
        F.coalesce(total("dot", "in"), F.lit(0)).alias("dot_in"), F.coalesce(total("dot", "out"), F.lit(0)).alias("dot_out"),
        F.coalesce(total("rt", "in", True), F.lit(0)).alias("cross_rt_in"),
        F.coalesce(total("dot", "in", True), F.lit(0)).alias("cross_dot_in"),
        (total("dot", "in", True, F.col("_s") * F.col("n")) / total("dot", "in", True)).alias("cross_dot_anger"))
    attrs = nodes.select("id", TX.clean_display_name(F.col("author_name")).alias("name"), "party", "state")
    return deg.join(attrs, "id", "left").select("id", "name", "party", "state", "rt_in", "rt_out", "dot_in",
                                                "dot_out", "cross_rt_in", "cross_dot_in", "cross_dot_anger")


def top_nodes(nodes: DataFrame, by: str, k: int = K.TOP_BRIDGES) -> DataFrame:
    """The top ``k`` nodes by a degree column (ties by id)."""
    return nodes.orderBy(F.desc(by), "id").limit(k)


def network_summary(edges: DataFrame, score: str = "anger") -> DataFrame:
    """K9: edges, messages, cross share of edges and of messages, n-weighted score of
    same-group and cross-group edges."""
    n = F.col("n")
    return edges.agg(
        F.count(F.lit(1)).alias("edges"), F.sum(n).alias("messages"),
        F.avg(F.col("is_cross").cast("int")).alias("cross_edge_share"),
        (F.sum(F.when(F.col("is_cross"), n).otherwise(0)) / F.sum(n)).alias("cross_msg_share"),
        (F.sum(F.when(~F.col("is_cross"), F.col(score) * n)) / F.sum(F.when(~F.col("is_cross"), n))).alias("anger_same"),
        (F.sum(F.when(F.col("is_cross"), F.col(score) * n)) / F.sum(F.when(F.col("is_cross"), n))).alias("anger_cross"))


def threshold_summary(edges: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """The summary at several minimum edge weights in one pass: each edge is
    paired with the (few, literal) thresholds it meets, then grouped by threshold."""
    ts = F.array(*[F.lit(t) for t in thresholds])
    e = edges.select("*", F.explode(F.filter(ts, lambda t: F.col("n") >= t)).alias("min_n"))
    n, x = F.col("n"), F.col("is_cross")
    return e.groupBy("min_n").agg(
        F.count(F.lit(1)).alias("edges"), F.sum(n).alias("messages"),
        F.avg(x.cast("int")).alias("cross_edge_share"),
        (F.sum(F.when(x, n).otherwise(0)) / F.sum(n)).alias("cross_msg_share"),
        (F.sum(F.when(~x, F.col("anger") * n)) / F.sum(F.when(~x, n))).alias("anger_same"),
        (F.sum(F.when(x, F.col("anger") * n)) / F.sum(F.when(x, n))).alias("anger_cross"))


def union_weights(rt: DataFrame, dot: DataFrame, weights=K.EDGE_WEIGHTS) -> DataFrame:
    """Undirected union of both edge kinds, weight = sum of w * ln(1 + n)."""
    def w(e, kind):
        return e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"),
                        (F.lit(weights[kind]) * F.log1p(F.col("n").cast("double"))).alias("w"))
    return w(rt, "retweet").unionByName(w(dot, "dot")).groupBy("a", "b").agg(F.sum("w").alias("weight"))


def edge_bucket(n: str = "n", cuts=K.EDGE_BUCKETS):
    """Edge weight -> bucket label ``[3,6)`` ... ``[50,inf)``."""
    c = F.col(n)
    expr = None
    for lo, hi in zip(cuts, cuts[1:]):
        cond = (c >= lo) & (c < hi)
        expr = F.when(cond, f"[{lo},{hi})") if expr is None else expr.when(cond, f"[{lo},{hi})")
    return expr.when(c >= cuts[-1], f"[{cuts[-1]},inf)")


def hubs(nodes: DataFrame, k: int = 3, group: str = "party") -> DataFrame:
    """Hub score ``rt_in + 4 * dot_in``, ranked within each group."""
    score = F.col("rt_in") + F.lit(K.HUB_DOT_WEIGHT) * F.col("dot_in")
    w = Window.partitionBy(group).orderBy(score.desc(), "id")
    return (nodes.withColumn("hub", score).withColumn("rank", F.row_number().over(w).cast("long"))
                 .filter(F.col("rank") <= k).select(group, "rank", "id", "name", TX.last_first("name").alias("label"), "hub"))


def mention_kinds(df: DataFrame, alias: DataFrame, nodes: DataFrame, person: str = "author", text: str = "text",
                  group: str = "party", flag: str = "angry", main=K.MAIN_GROUPS) -> DataFrame:
    """Each non-retweet addressing a member is a reply (starts with ``@``), a
    call-out (``.@``) or a plain mention; by same/cross group of the first handle,
    the share of flagged messages.  Counted per (kind, group, handle) before any join."""
    t = F.col(text)
    kind = (F.when(t.rlike(r"^@\w"), "reply").when(t.rlike(K.DOT_MENTION), "callout")
             .when(t.rlike(r"@\w"), "mention"))
    m = df.filter(~TX.is_retweet(text)).select(group, flag, kind.alias("kind"),
                                               F.lower(TX.rx_group(text, r"@(\w+)")).alias("h"))
    m = m.filter(F.col("kind").isNotNull()).groupBy("kind", group, "h").agg(
        F.count(F.lit(1)).alias("n"), F.count(flag).alias("_k"), F.sum(flag).alias("_t"))
    target = alias.join(nodes.select("id", F.col(group).alias("tg")), "id").select("h", "tg")
    m = m.join(target, "h")
    rel = (F.when((F.col(group) == F.col("tg")), "same")
            .when(F.col(group).isin(*main) & F.col("tg").isin(*main), "cross").otherwise("other"))
    return m.groupBy("kind", rel.alias("relation")).agg(
        F.sum("n").alias("n"), F.try_divide(F.sum("_t"), F.sum("_k")).alias("share_angry"))


def scaled_degrees(nodes: DataFrame, by: str = "rt_in") -> DataFrame:
    """node size as the square root of a degree over the largest one (0 to 1)."""
    top = nodes.agg(F.max(by)).first()[0]
    return nodes.withColumn("size", F.sqrt(F.col(by) / F.lit(float(top) if top else 1.0)))
