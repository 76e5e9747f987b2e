"""Distinctive terms and drivers of peaks.

Design for scale: one aggregate turns the messages into sums per week and group and
``(week, token) -> messages``, written once; series, terms and drivers read those small
tables, and meet the peak windows by an equi-join on the week.  Texts of examples are
fetched for the winning ids alone.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import calendar as cal
from ..functions import text as T
from ..functions.ordering import highest, highest_id
from ..session import materialize as keep_once
from ..session import stored
from .series import window_offsets

ALL = ""  # stands for "any message" among the tokens, so one aggregate also counts messages


def token_counts(msgs: DataFrame, weeks: DataFrame, text: str = "text", ts: str = "ts", score: str = "anger",
                 threshold: float = K.ANGRY_THRESHOLD, tokens: str | None = None) -> DataFrame:
    """Over messages of ``weeks`` (wk) whose score passes the threshold, the number of
    messages with each token per week; the token ``ALL`` counts every such message.
    ``tokens`` names a column that holds the distinct tokens already (C22 applied upstream)."""
    toks = F.col(tokens) if tokens else T.tokens(text)
    hot = msgs.filter(F.col(score) > threshold).select(cal.week_start(ts).alias("wk"), toks.alias("_t"))
    hot = hot.join(weeks, "wk", "left_semi")
    return (hot.select("wk", F.explode(F.concat(F.array(F.lit(ALL)), F.coalesce("_t", F.array().cast("array<string>"))))
                       .alias("token")).groupBy("wk", "token").agg(F.count(F.lit(1)).alias("c")))


@dataclass(frozen=True)
class Weeks:
    """What the spike table needs of the messages. ``groups``: per week and group the messages (n), those
    with a score (scored), their sum (total), how many pass the threshold (flagged) and the packed
    highest-scoring one (best). ``tokens``: per week and token, messages over the threshold."""

    groups: DataFrame
    tokens: DataFrame


def _group_sums(score: str, tie: str, threshold: float) -> list[Column]:
    x = F.col(score)
    return [F.count(F.lit(1)).alias("n"), F.count(x).alias("scored"), F.sum(x).alias("total"),
            F.sum((x > threshold).cast("long")).alias("flagged"), F.max(highest(x, tie)).alias("best")]


def _added() -> list[Column]:
    """The sums of sums."""
    return [*[F.sum(c).alias(c) for c in ("n", "scored", "total", "flagged")], F.max("best").alias("best")]


def week_groups(msgs: DataFrame, ts: str = "ts", score: str = "anger", group: str = "party", tie: str = "msg_id",
                threshold: float = K.ANGRY_THRESHOLD) -> DataFrame:
    """:class:`Weeks` ``groups`` alone."""
    return msgs.groupBy(cal.week_start(ts).alias("wk"), F.col(group).alias("grp")).agg(*_group_sums(score, tie, threshold))


def weeks_of(msgs: DataFrame, text: str = "text", ts: str = "ts", score: str = "anger", group: str = "party",
             tie: str = "msg_id", threshold: float = K.ANGRY_THRESHOLD, tokens: str | None = None,
             key: str | None = None, token_table: DataFrame | None = None) -> Weeks:
    """The messages read once: one aggregate, written, from which series, terms and drivers follow.

    Messages that hold their own text (or ``tokens``) give a row each and, over the threshold, a row for
    each token. Where messages share texts, ``key`` names a column and ``token_table`` (key, tokens) the
    tokens: the hot messages are counted per week and text before those meet their tokens, so no message
    carries a text."""
    wk, hot = cal.week_start(ts).alias("wk"), F.col(score) > threshold
    none = F.array().cast("array<string>")
    if key:
        cells = stored(msgs.groupBy(wk, F.col(group).alias("grp"), F.when(hot, F.col(key)).alias("_key")).agg(
            *_group_sums(score, tie, threshold)), "weeks")
        texts = cells.filter(F.col("_key").isNotNull()).groupBy("wk", "_key").agg(F.sum("n").alias("n"))
        named = token_table.select(F.col(token_table.columns[0]).alias("_key"), F.col(token_table.columns[1]).alias("_t"))
        found = texts.join(named, "_key").select("wk", "n", F.explode(F.concat(F.array(F.lit(ALL)), F.coalesce("_t", none))).alias("token"))
        return Weeks(cells.groupBy("wk", "grp").agg(*_added()), found.groupBy("wk", "token").agg(F.sum("n").alias("c")))
    toks = F.col(tokens) if tokens else T.tokens(text)
    # the first entry, without a token, stands for the message itself
    own = F.concat(F.array(F.lit(None).cast("string")), F.when(hot, F.concat(F.array(F.lit(ALL)), F.coalesce(toks, none))).otherwise(none))
    rows = msgs.select(wk, F.col(group).alias("grp"), score, tie, F.explode(own).alias("token"))
    cells = stored(rows.groupBy("wk", "grp", "token").agg(*_group_sums(score, tie, threshold)), "weeks")
    return Weeks(cells.filter(F.col("token").isNull()).drop("token"),
                 cells.filter(F.col("token").isNotNull()).groupBy("wk", "token").agg(F.sum("n").alias("c")))


def week_means(groups_table: DataFrame, score: str = "anger", groups=K.MAIN_GROUPS, min_n: int = K.MIN_N_WEEK) -> DataFrame:
    """The weekly series of :func:`series.weekly_series` from :class:`Weeks` ``groups``."""
    def mean(of: Column, out: str) -> Column:
        return F.try_divide(F.sum(F.when(of, F.col("total"))), F.sum(F.when(of, F.col("scored")))).alias(out)

    each = [(F.col("grp") == g, t) for g, t in zip(groups, ("dem", "rep"))]
    return groups_table.groupBy("wk").agg(
        F.sum("n").alias("n"), mean(F.lit(True), score), F.try_divide(F.sum("flagged"), F.sum("scored")).alias("share_angry"),
        *[mean(of, f"{score}_{t}") for of, t in each],
        *[F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0)).alias(f"n_{t}") for of, t in each]).filter(F.col("n") >= min_n)


def distinctive_terms(msgs: DataFrame, peaks: DataFrame, text: str = "text", ts: str = "ts",
                      score: str = "anger", min_count: int = K.MIN_TERM_COUNT, top_words: int = K.TOP_WORDS,
                      top_tags: int = K.TOP_TAGS, tokens: str | None = None,
                      threshold: float = K.ANGRY_THRESHOLD) -> DataFrame:
    """:func:`terms_of_counts` of the messages, which are read once, by :func:`token_counts`."""
    weeks = window_offsets(peaks).select("wk").distinct()
    return terms_of_counts(token_counts(msgs, weeks, text, ts, score, threshold, tokens), peaks, min_count, top_words, top_tags)


def terms_of_counts(per: DataFrame, peaks: DataFrame, min_count: int = K.MIN_TERM_COUNT, top_words: int = K.TOP_WORDS,
                    top_tags: int = K.TOP_TAGS) -> DataFrame:
    """Per peak week, tokens over-represented in the week vs the surrounding
    weeks (-6..+7, the week itself excluded), smoothed log ratio
    ``ln((cw+1)/nw) - ln((cb+1)/nb)``, ``cw >= min_count``; top words and top tags
    joined by spaces (ties: score rounded to 9 dp desc, then token asc).

    ``per``: (wk, token, c), with the token ``ALL`` for any message."""
    here = F.col("in_peak")
    counts = per.join(window_offsets(peaks), "wk").groupBy("peak", "token").agg(
        F.coalesce(F.sum(F.when(here, F.col("c"))), F.lit(0)).alias("cw"),
        F.coalesce(F.sum(F.when(~here, F.col("c"))), F.lit(0)).alias("cb"))
    of_peak = Window.partitionBy("peak")
    size = lambda c: F.greatest(F.lit(1), F.max(F.when(F.col("token") == ALL, F.col(c))).over(of_peak))
    kept = counts.filter((F.col("token") == ALL) | (F.col("cw") >= min_count))
    scored = kept.withColumn("nw", size("cw")).withColumn("nb", size("cb")).filter(F.col("token") != ALL).withColumn(
        "score", F.log((F.col("cw") + 1) / F.col("nw")) - F.log((F.col("cb") + 1) / F.col("nb")))
    scored = scored.withColumn("is_tag", F.col("token").startswith("#"))
    # equal ratios computed along different paths differ in the last bit; rank on 9 decimals
    w = Window.partitionBy("peak", "is_tag").orderBy(F.round("score", 9).desc(), F.asc("token"))
    ranked = scored.withColumn("r", F.row_number().over(w)).filter(
        F.when(F.col("is_tag"), F.col("r") <= top_tags).otherwise(F.col("r") <= top_words))

    def joined(tag: bool):
        best = F.sort_array(F.collect_list(F.when(F.col("is_tag") == tag, F.struct("r", "token"))))
        return F.array_join(F.transform(best, lambda s: s["token"]), " ")

    lists = ranked.groupBy("peak").agg(joined(False).alias("keywords"), joined(True).alias("hashtags"))
    out = peaks.select(F.col("wk").alias("peak")).join(lists, "peak", "left")
    return out.select(F.col("peak").alias("wk"), F.coalesce("keywords", F.lit("")).alias("keywords"),
                      F.coalesce("hashtags", F.lit("")).alias("hashtags"))


def peak_drivers(msgs: DataFrame, peaks: DataFrame, ts: str = "ts", score: str = "anger", group: str = "party",
                 groups=K.MAIN_GROUPS, margin: float = K.DRIVER_MARGIN, tie: str = "msg_id") -> DataFrame:
    """:func:`drivers_of_groups` of the messages, added up per week and group."""
    return drivers_of_groups(week_groups(msgs, ts, score, group, tie), peaks, groups, margin)


def drivers_of_groups(per: DataFrame, peaks: DataFrame, groups=K.MAIN_GROUPS, margin: float = K.DRIVER_MARGIN) -> DataFrame:
    """Each group's mean in the peak week minus its own mean in the surrounding
    weeks; ``Dem``/``Rep``/``both`` by a margin on the raw values; and the id of the week's
    highest-scoring message (``example_id``; ties: the smallest id).

    ``per``: :class:`Weeks` ``groups``."""
    def of(g: str, c: str, out: str) -> Column:
        return F.sum(F.when(F.col("grp") == g, F.col(c))).alias(out)

    d, r = groups[0], groups[1]
    per_wk = per.groupBy("wk").agg(of(d, "total", "_ds"), of(d, "scored", "_dn"), of(r, "total", "_rs"), of(r, "scored", "_rn"),
                                   F.max("best").alias("_ex"))
    m = per_wk.join(window_offsets(peaks), "wk")
    inside = F.col("in_peak")

    def mean(s, n, flag):
        c = inside if flag else ~inside
        return F.sum(F.when(c, F.col(s))) / F.sum(F.when(c, F.col(n)))

    agg = m.groupBy("peak").agg(
        (mean("_ds", "_dn", True) - mean("_ds", "_dn", False)).alias("dem_excess"),
        (mean("_rs", "_rn", True) - mean("_rs", "_rn", False)).alias("rep_excess"),
        F.max(F.when(inside, F.col("_ex"))).alias("_ex"))
    driven = (F.when(F.col("dem_excess") > F.col("rep_excess") + margin, "Dem")
               .when(F.col("rep_excess") > F.col("dem_excess") + margin, "Rep").otherwise("both"))
    return agg.select(F.col("peak").alias("wk"), "dem_excess", "rep_excess", driven.alias("driven_by"),
                      highest_id("_ex").alias("example_id"))


def label_lookup(df: DataFrame, labels: DataFrame | None, key: str = "wk", out: str = "event") -> DataFrame:
    """Attach caller-supplied labels (key, label) by key; '' when missing."""
    if labels is None:
        return df.withColumn(out, F.lit(""))
    lab = labels.select(F.col(labels.columns[0]).alias(key), F.col(labels.columns[1]).alias(out))
    return df.join(lab, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit("")))


def spike_report(msgs: DataFrame, min_week_n: int = K.MIN_N_WEEK, k: int = K.TOP_SPIKES,
                 min_count: int = K.MIN_TERM_COUNT, labels: DataFrame | None = None,
                 min_gap_days: int = K.MIN_GAP_DAYS, **texts) -> DataFrame:
    """The seismograph table: greedy peaks of excess over the rolling baseline, each
    described by its distinctive terms, its drivers, the id of its example and a label.

    The messages are read once, by :func:`weeks_of`, which ``texts`` tells where their tokens are."""
    from .series import baseline_and_spikes, greedy_peaks

    weeks = weeks_of(msgs, **texts)
    series = baseline_and_spikes(week_means(weeks.groups, min_n=min_week_n))
    # k rows at most, read by three branches: kept once in the shared checkpoint folder
    peaks = keep_once(greedy_peaks(series, k=k, min_gap_days=min_gap_days).select(
        "wk", "n", "anger", "baseline", "excess", "spike_score"))
    terms = terms_of_counts(weeks.tokens, peaks.select("wk"), min_count=min_count)
    drivers = drivers_of_groups(weeks.groups, peaks.select("wk"))
    return label_lookup(peaks.join(terms, "wk", "left").join(drivers, "wk", "left"), labels)
