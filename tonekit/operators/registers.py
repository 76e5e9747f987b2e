"""Lexicon registers and distances between group score profiles (H1-H7).

Registers are boolean columns from regex tests; shares are grouped averages.
Profile distance is one conditional aggregate per key (mean of each score for
each of the two groups), so no pivot and no self-join; the exemplars' ids come out of the
same aggregate, and texts are fetched for the winners alone.
"""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as TX
from ..functions.ordering import highest, highest_id, highest_score

_WORD = "A-Za-z0-9_"


def portable(pattern: str) -> str:
    """``\\b`` spelled as explicit ASCII word boundaries for the Java engine, whose own
    ``\\b`` counts accented letters as word characters; this way Spark agrees with
    RE2 (the reference's SQL engine) on non-English text.  Zero-width lookarounds keep
    the scan fast: ``(?<![A-Za-z0-9_])`` before a word, ``(?![A-Za-z0-9_])`` after it."""
    out = re.sub(r"\\b(?=[A-Za-z(\[])", lambda _: f"(?<![{_WORD}])", pattern)
    return out.replace(r"\b", f"(?![{_WORD}])")


def portable_re2(pattern: str) -> str:
    """The same boundaries for engines without lookarounds (RE2): consuming classes
    ``(?:^|[^...])`` / ``(?:[^...]|$)`` -- equal as a match test."""
    out = re.sub(r"\\b(?=[A-Za-z(\[])", lambda _: f"(?:^|[^{_WORD}])", pattern)
    return out.replace(r"\b", f"(?:[^{_WORD}]|$)")


def positive_tone(pos=K.POSITIVE_EMOTIONS, neg=K.NEGATIVE_EMOTIONS, t: float = K.ANGRY_THRESHOLD) -> Column:
    """Any positive score over the threshold and no negative one."""
    any_pos = None
    for e in pos:
        c = F.col(e) > t
        any_pos = c if any_pos is None else any_pos | c
    cond = any_pos
    for e in neg:
        cond = cond & (F.col(e) <= t)
    return cond


def negative_tone(neg=K.NEGATIVE_EMOTIONS, t: float = K.ANGRY_THRESHOLD) -> Column:
    """Any negative score over the threshold."""
    cond = None
    for e in neg:
        c = F.col(e) > t
        cond = c if cond is None else cond | c
    return cond


def text_flags(df: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """H1: one boolean column per named pattern, tested on the lower-cased text."""
    d = df.select("*", F.lower(F.col(text)).alias("_low"))
    return d.select(*[F.col(c) for c in df.columns],
                    *[F.col("_low").rlike(portable(p)).alias(name) for name, p in patterns.items()])


def add_registers(df: DataFrame, text: str = "text", group: str = "party", civic: str = K.CIVIC,
                  gratitude: str = K.GRATITUDE, outgroup: dict | None = None,
                  pos=K.POSITIVE_EMOTIONS, neg=K.NEGATIVE_EMOTIONS, flags_ready: bool = False) -> DataFrame:
    """H1/H2: regex flags on the lower-cased text; the out-group pattern depends on
    the author's own group (no pattern -> FALSE).

    With ``flags_ready`` the text flags (``civic_lang``, ``grat_lang`` and one
    ``_og_<group>`` column per out-group pattern) were computed already -- e.g. once per
    distinct text by :func:`text_flags` -- and only the group choice is made here."""
    outgroup = outgroup if outgroup is not None else {"Democrat": K.DEM_OUT, "Republican": K.REP_OUT}
    if not flags_ready:
        pats = {"civic_lang": civic, "grat_lang": gratitude, **{f"_og_{g}": p for g, p in outgroup.items()}}
        df = text_flags(df, pats, text)
    og = None
    for g in outgroup:
        cond = F.col(group) == g
        og = F.when(cond, F.col(f"_og_{g}")) if og is None else og.when(cond, F.col(f"_og_{g}"))
    og = og.otherwise(F.lit(False)) if og is not None else F.lit(False)
    return (df.withColumn("positive_tone", positive_tone(pos, neg)).withColumn("negative_tone", negative_tone(neg))
              .withColumn("outgroup", og).drop(*[f"_og_{g}" for g in outgroup]))


def register_shares(df: DataFrame, keys: Sequence[str], min_n: int = 0) -> DataFrame:
    """H3: n and the five register shares per key (after :func:`add_registers`)."""
    def share(c: Column) -> Column:
        return F.avg(c.cast("int"))

    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col("positive_tone") & F.col("civic_lang")).alias("civic"),
        share(F.col("positive_tone") & F.col("grat_lang")).alias("gratitude"),
        share(F.col("negative_tone") & F.col("outgroup")).alias("polarizing"),
        share(F.col("civic_lang")).alias("any_civic_lang"),
        share(F.col("outgroup")).alias("any_outgroup"))
    return out.filter(F.col("n") >= min_n) if min_n else out


def profile_distance(df: DataFrame, key: str, scores: Sequence[str] = tuple(K.EMOTIONS), group: str = "party",
                     groups: Sequence[str] = tuple(K.MAIN_GROUPS), min_n: int = 0,
                     labels: Sequence[str] = ("Democrats higher", "Republicans higher"),
                     best_of: tuple[str, str] | None = None) -> DataFrame:
    """H5/H6: per key, the gap vector (mean of group A minus mean of group B), its
    Euclidean norm, the score with the largest absolute gap (first in ``scores`` on
    ties) and its sign.  Keys where either group is missing or under ``min_n`` rows
    are skipped.  One grouped aggregate; partial aggregation applies.

    ``best_of`` (flag, id): also, per group and score, the flagged row with the highest score
    (ties: smallest id) as ``_best_a_<score>`` and ``_best_b_<score>``, packed by ``highest``."""
    a, b = groups
    ga, gb = F.col(group) == a, F.col(group) == b
    aggs = [F.count(F.when(ga, 1)).alias("_na"), F.count(F.when(gb, 1)).alias("_nb")]
    for s in scores:
        aggs += [F.avg(F.when(ga, F.col(s))).alias(f"_a_{s}"), F.avg(F.when(gb, F.col(s))).alias(f"_b_{s}")]
    if best_of:
        ok, tie = best_of
        for s in scores:
            aggs += [F.max(F.when(g & F.col(ok), highest(s, tie))).alias(f"_best_{t}_{s}") for t, g in (("a", ga), ("b", gb))]
    m = df.groupBy(key).agg(*aggs).filter((F.col("_na") > 0) & (F.col("_nb") > 0)
                                          & (F.col("_na") >= min_n) & (F.col("_nb") >= min_n))
    gaps = [(F.col(f"_a_{s}") - F.col(f"_b_{s}")).alias(f"gap_{s}") for s in scores]
    best = [f"_best_{t}_{s}" for s in scores for t in "ab"] if best_of else []
    m = m.select(key, *gaps, *best)
    sq = None
    for s in scores:
        t = F.col(f"gap_{s}") * F.col(f"gap_{s}")
        sq = t if sq is None else sq + t
    arr = F.array(*[F.struct(F.abs(F.col(f"gap_{s}")).alias("m"), F.lit(-i).alias("neg_i"), F.lit(s).alias("name"),
                             F.col(f"gap_{s}").alias("g")) for i, s in enumerate(scores)])
    big = F.array_max(arr)
    return m.select(key, F.sqrt(sq).alias("distance"), big["name"].alias("biggest_gap"),
                    F.when(big["g"] > 0, labels[0]).otherwise(labels[1]).alias("gap_sign"),
                    *[f"gap_{s}" for s in scores], *best)


def exemplar_text_ok(text: str = "text") -> Column:
    """H7: no retweet, of exemplar length, and not a link alone."""
    lo, hi = K.EXEMPLAR_LEN
    return (~TX.is_retweet(text) & F.length(text).between(lo, hi)
            & (F.length(TX.rx_replace(text, K.LINK, "")) >= K.EXEMPLAR_MIN_NO_LINK))


def exemplars(df: DataFrame, key: str = "mo", scores: Sequence[str] = tuple(K.EMOTIONS), group: str = "party",
              groups: Sequence[str] = tuple(K.MAIN_GROUPS), ok: str = "text_ok", tie: str = "msg_id",
              min_n: int = 0) -> DataFrame:
    """H7: per key and group, the score where the group most exceeds the other (max gap
    for A, min gap for B; first in order on ties), then the id of that group's
    highest-scoring row on that score among those flagged ``ok`` (ties: smallest id).
    Returns key, group, emo, id, score.

    Gaps and candidates come out of one aggregate of the rows, which carry no text; the
    caller fetches author and text of the few winning ids."""
    a, b = groups
    prof = profile_distance(df, key, scores, group, groups, min_n, best_of=(ok, tie))

    def pick(grp: str, side: str, sign: int):
        arr = F.array(*[F.struct((sign * F.col(f"gap_{s}")).alias("g"), F.lit(-i).alias("neg_i"), F.lit(s).alias("name"),
                                 F.col(f"_best_{side}_{s}").alias("best")) for i, s in enumerate(scores)])
        # the best row plays no part in the choice: gap, then order, decide
        top = F.array_max(F.transform(arr, lambda x: F.struct(x["g"], x["neg_i"])))
        win = F.element_at(F.filter(arr, lambda x: x["neg_i"] == top["neg_i"]), 1)
        return F.struct(F.lit(grp).alias(group), win["name"].alias("emo"), highest_id(win["best"]).alias("id"),
                        highest_score(win["best"]).alias("score"))

    rows = prof.select(key, F.inline(F.array(pick(a, "a", 1), pick(b, "b", -1))))
    return rows.filter(F.col("id").isNotNull())
