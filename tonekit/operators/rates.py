"""Conditional-rate tables and lookups, the "forecast" family.

The messages are counted once into small cells; everything else is a grouped aggregate
or a join over those.  The lookup (J6) answers a whole table of requests with equi-joins
against the grouping sets of the cells, never a request-by-request loop.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.calendar import percent_text
from ..functions.ordering import newest


def latest(df: DataFrame, key: str, attrs: Sequence[str], ts: str = "ts", tie: str = "msg_id",
           sums: Sequence[Column] = (), totals: Sequence[Column] = ()) -> DataFrame:
    """E5: per key, each attribute as of its most recent non-NULL value (ties on the timestamp broken
    by ``tie``). ``sums`` are further aggregates of the rows, ``totals`` the aggregates that add
    those up.

    The rows are counted into cells of (key, attribute values) first, each with its newest (time,
    id) as one number, so they are never sorted; the few cells of a key decide on its attributes."""
    cells = df.groupBy(key, *attrs).agg(F.max(newest(ts, tie)).alias("newest"), *sums)
    return cells.groupBy(key).agg(*_latest_of_cells(attrs), *totals)


def _latest_of_cells(attrs: Sequence[str]) -> list[Column]:
    return [F.max_by(F.col(a), F.when(F.col(a).isNotNull(), F.col("newest"))).alias(a) for a in attrs]


def message_cells(df: DataFrame, key: str = "author", attrs: Sequence[str] = ("author_name", "party", "state"),
                  dims: Sequence[str] = ("era", "band"), flag: str = "angry", score: str = "anger", ts: str = "ts",
                  tie: str = "msg_id") -> DataFrame:
    """The messages counted once per key, attribute values and dimensions: n, flagged, the score
    sum and the newest (timestamp, id). Names, leaderboards, ladders and lookups all follow from
    these cells, so the message table is read once and never joined."""
    return df.groupBy(key, *attrs, *dims).agg(
        F.count(F.lit(1)).alias("n"), F.sum(flag).alias("flagged"), F.sum(score).alias("score_sum"),
        F.max(newest(ts, tie)).alias("newest"))


def latest_from_cells(cells: DataFrame, key: str = "author",
                      attrs: Sequence[str] = ("author_name", "party", "state")) -> DataFrame:
    """E5 over :func:`message_cells`: the newest cell with a non-NULL value decides."""
    return cells.groupBy(key).agg(*_latest_of_cells(attrs))


def pooled(cells: DataFrame, keys: Sequence[str], min_n: int = 0, mean: str | None = None) -> DataFrame:
    """J1-J3 over cells: n, flagged share and optionally the mean score per ``keys``."""
    aggs = [F.sum("n").alias("n"), (F.sum("flagged") / F.sum("n")).alias("share_angry")]
    if mean:
        aggs.append((F.sum("score_sum") / F.sum("n")).alias(mean))
    return cells.groupBy(*keys).agg(*aggs).filter(F.col("n") >= min_n)


def rate_cells(df: DataFrame, keys: Sequence[str], flag: str = "angry", min_n: int = K.MIN_N_FORECAST_CELL,
               where: Column | None = None, mean_of: str | None = None) -> DataFrame:
    """Share of flagged messages per cell, ``n >= min_n``, highest share first."""
    if where is not None:
        df = df.filter(where)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(flag).alias("share_angry")]
    if mean_of:
        aggs.append(F.avg(mean_of).alias(f"mean_{mean_of}"))
    return df.groupBy(*keys).agg(*aggs).filter(F.col("n") >= min_n).orderBy(F.desc("share_angry"), *keys)


def night_day(cells: DataFrame, key: str, band: str = "band", day=K.DAY_BAND, night=K.NIGHT_BANDS,
              min_night: int = K.MIN_N_NIGHT) -> DataFrame:
    """Per author, flagged share at night vs during the working day, from cells."""
    is_night = F.col(band).isin(*night)

    def of(cond: Column, c: str) -> Column:
        return F.sum(F.when(cond, F.col(c)))

    out = cells.groupBy(key).agg(
        F.sum("n").alias("n"), F.coalesce(of(is_night, "n"), F.lit(0)).alias("n_night"),
        F.try_divide(of(F.col(band) == day, "flagged"), of(F.col(band) == day, "n")).alias("daytime"),
        F.try_divide(of(is_night, "flagged"), of(is_night, "n")).alias("nighttime"))
    return (out.filter(F.col("n_night") >= min_night)
               .withColumn("night_minus_day", F.col("nighttime") - F.col("daytime")))


def ladder(cells: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """The share under a growing list of conditions, in ONE pass over the cells
    (conditional sums, then unpivot), instead of one scan per condition."""
    one = cells.agg(*[F.try_divide(F.sum(F.when(cond, F.col("flagged"))), F.sum(F.when(cond, F.col("n")))).alias(f"_p{i}")
                      for i, (_, cond) in enumerate(steps)])
    rows = F.array(*[F.struct(F.lit(lbl).alias("known"), F.col(f"_p{i}").alias("p"))
                     for i, (lbl, _) in enumerate(steps)])
    return one.select(F.inline(rows))


def ladder_order(ladder_df: DataFrame, first: str = "nothing") -> DataFrame:
    """The baseline row first, the rest by probability."""
    return ladder_df.orderBy(F.when(F.col("known") == first, 0).otherwise(1), "p")


def verdict(p: str = "p") -> Column:
    """Probability -> verdict text; cut points are tested in this order."""
    x, out = F.col(p), None
    for (cut, side), text in zip(K.VERDICT_CUTS, K.VERDICT_TEXTS):
        cond = x >= cut if side == ">=" else x < cut
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out.otherwise(K.VERDICT_ELSE)


def _known_rates(cells: DataFrame, dims: Sequence[str], fixed: Sequence[str] = ()) -> DataFrame:
    """Every way of leaving some of ``dims`` unknown (NULL) while ``fixed`` stay known, with
    pooled n and rate: only those grouping sets are built."""
    sets = [[*fixed, *(d for i, d in enumerate(dims) if mask >> i & 1)] for mask in range(1 << len(dims))]
    return cells.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*fixed, *dims)]).agg(
        F.sum(F.col("share_angry") * F.col("n")).alias("_sn"), F.sum("n").alias("_n"))


def rate_lookup(requests: DataFrame, cells: DataFrame, member_cells: DataFrame,
                group: str = "party", era: str = "era", band: str = "band", member: str = "name") -> DataFrame:
    """For each request row (NULL = unknown) the most specific non-empty answer.

    Member cells answer first when a member is named and any of that member's cells
    match; otherwise the group/era/band cells; otherwise ``(NULL, 0)``.  Each source
    is reduced to its cube (all wildcard patterns, bounded by the category counts)
    and matched with null-safe equi-joins, so the whole request table is one job."""
    gc = _known_rates(cells, [group, era, band])
    mc = _known_rates(member_cells, [era, band], fixed=[member])
    r = requests.alias("r")
    g = gc.alias("g")
    m = mc.alias("m")
    j = (r.join(g, r[group].eqNullSafe(g[group]) & r[era].eqNullSafe(g[era]) & r[band].eqNullSafe(g[band]), "left")
          .select("r.*", F.col("g._sn").alias("_gsn"), F.col("g._n").alias("_gn")))
    j = j.alias("j").join(m, (F.col(f"j.{member}") == m[member]) & F.col(f"j.{era}").eqNullSafe(m[era])
                          & F.col(f"j.{band}").eqNullSafe(m[band]), "left")
    j = j.select("j.*", F.col("m._sn").alias("_msn"), F.col("m._n").alias("_mn"))
    use_m = F.col("_mn").isNotNull()
    def told(form: str, c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.format_string(form, F.col(c)))

    desc_m = F.concat_ws("", F.col(member), told(K.MEMBER_FORMS["era"], era), told(K.MEMBER_FORMS["band"], band))
    parts = F.concat_ws(", ", told(K.CELL_FORMS["group"], group), told(K.CELL_FORMS["era"], era),
                        told(K.CELL_FORMS["band"], band))
    desc_g = F.when(parts == "", F.lit(K.NOTHING_KNOWN)).otherwise(parts)
    return j.select(
        *[F.col(c) for c in requests.columns],
        F.when(use_m, F.col("_msn") / F.col("_mn")).when(F.col("_gn").isNotNull(), F.col("_gsn") / F.col("_gn"))
         .alias("p"),
        F.coalesce(F.when(use_m, F.col("_mn")), F.col("_gn"), F.lit(0)).cast("long").alias("n"),
        F.when(use_m, desc_m).when(F.col("_gn").isNotNull(), desc_g)
         .otherwise(F.lit(K.NO_DATA)).alias("description"),
    ).withColumn("verdict", verdict("p")).withColumn("p_text", percent_text("p"))


def statement(df: DataFrame, ids: DataFrame, bands: Sequence[str], era_label: str, author: str = "author",
              flag: str = "angry") -> tuple[DataFrame, DataFrame]:
    """The messages of the authors in ``ids`` in some bands of one era: the summary row
    (p, n, from, to) and the message rows in time order (never collected).  The names were
    resolved to ids before; band and era filter the messages before they meet them."""
    sel = df.filter(F.col("band").isin(*bands) & (F.col("era") == era_label)).join(ids.select(author), author, "left_semi")
    summary = sel.agg(F.avg(flag).alias("p"), F.count(F.lit(1)).alias("n"),
                      F.to_date(F.min("ts")).alias("from"), F.to_date(F.max("ts")).alias("to"))
    msgs = sel.select(F.col("ts").alias("t"), F.col(flag).alias("a"), F.col("text").alias("x")).orderBy("t")
    return summary, msgs
