"""Registers, profile distance, exemplars and scoring queries."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import calendar as cal
from ..functions import text as TX
from ..operators import registers as RG
from ..operators import scoring as SC
from ..operators import terms as TM
from ..sources.files import read_table
from . import oracle_views as O
from .registry import register
from .series_queries import _TOKENS as _TOKENS_SQL  # DuckDB twin of functions.text.tokens
from .views import analysis_posts, attach_document_text, msgs, winners_with_text

# Test-scale analog lexicons: the published word lists (constants.CIVIC etc., the
# library defaults) never occur in the driver's invented documents, so the queries over
# those use words that do occur; ``published_registers`` runs the published lists over
# the composed messages.
CIVIC_T = r"(licensed?|\bmit\b)"
GRAT_T = r"(apache|\bfrom\b)"
OUT_T = {"Democrat": r"(\bthis\b|\bwith\b)", "Republican": r"(\bthat\b|\bfor\b)"}
MIN_MONTH = 30
MIN_PROFILE = 10
TOP_MONTHS = 8
POST_SCORES = ["anger", "negative", "disgust", "joy", "optimism", "fear", "sadness"]


def scored_view(spark, root, also: dict | None = None, flags: bool = False):
    """Two-group posts with the scores of their text by the lexicon scorer (and, with
    ``flags``, the per-text register flags), plus the month; the text itself stays behind."""
    d = analysis_posts(spark, root).filter(F.col("party").isin(*K.MAIN_GROUPS)).drop(*POST_SCORES)
    pats = {"civic_lang": CIVIC_T, "grat_lang": GRAT_T, **{f"_og_{g}": p for g, p in OUT_T.items()}}
    d = attach_document_text(spark, root, d, scored=True, flags=pats if flags else None, also=also, keep_text=False)
    return d.withColumn("mo", cal.month_start("ts"))


def register_view(spark, root):
    """:func:`scored_view` plus the register flags and the tone columns."""
    return RG.add_registers(scored_view(spark, root, flags=True), outgroup=OUT_T, flags_ready=True)


# Oracle: tones by the largest score of a list, the out-group pattern by lookup, and every
# share as a filtered count.
def _any_word(p: str) -> str:
    return f"regexp_matches(lower(text), '{RG.portable_re2(p)}')"


def _tones(positive, negative) -> str:
    return (f"list_max([{', '.join(positive)}]) > 0.5 AND list_max([{', '.join(negative)}]) <= 0.5 AS warm, "
            f"list_max([{', '.join(negative)}]) > 0.5 AS hostile")


def _reg_sql() -> str:
    src = f"SELECT * EXCLUDE ({', '.join(POST_SCORES)}) FROM ({O.D_POSTS_TEXT}) p WHERE list_contains({K.MAIN_GROUPS}, party)"
    about = "map {" + ", ".join(f"'{g}': {_any_word(p)}" for g, p in OUT_T.items()) + "}[party]"
    return f"""SELECT s.*, CAST(ts - INTERVAL (day(ts) - 1) DAY AS DATE) AS mo, {_tones(K.POSITIVE_EMOTIONS, K.NEGATIVE_EMOTIONS)},
       {_any_word(CIVIC_T)} AS has_civic, {_any_word(GRAT_T)} AS has_thanks, {about} AS about_others
FROM ({O.lexicon_sql(src)}) s"""


REG = _reg_sql()
def _share(cond: str, name: str) -> str:
    return f"ROUND(count(*) FILTER ({cond}) / count(*), 6) AS {name}"


SHARES = "count(*) AS n, " + ", ".join(_share(c, n) for c, n in (
    ("warm AND has_civic", "civic"), ("warm AND has_thanks", "gratitude"), ("hostile AND about_others", "polarizing"),
    ("has_civic", "any_civic_lang"), ("about_others", "any_outgroup")))


def _r(body):
    return O.with_views(body, r=REG)


@register("register_shares", _r(f"SELECT year, party, {SHARES} FROM r GROUP BY year, party"))
def register_shares(spark, root):
    """H1-H3: civic / gratitude / polarizing shares by year and group."""
    return RG.register_shares(register_view(spark, root), ["year", "party"])


@register("register_month_party", _r(f"SELECT mo, party, {SHARES} FROM r GROUP BY mo, party"))
def register_month_party(spark, root):
    """H3: the register shares by month and group."""
    return RG.register_shares(register_view(spark, root), ["mo", "party"])


@register("outgroup_lexicon", _r("""SELECT party, count(*) AS n, count(*) FILTER (about_others) AS outgroup_msgs,
       count(*) FILTER (has_civic) AS civic_msgs FROM r GROUP BY party"""))
def outgroup_lexicon(spark, root):
    """H2: the group-dependent out-group pattern, counted per group."""
    return register_view(spark, root).groupBy("party").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("outgroup").alias("outgroup_msgs"),
        F.count_if("civic_lang").alias("civic_msgs"))


# Event labels by month: a table of (month, nation) made from the nations, for every other
# month of the span, so some months have no label.
_EVENTS_SQL = "SELECT CAST(DATE '1995-01-01' + to_months(CAST(2 * n_nationkey AS INTEGER)) AS DATE) AS mo, n_name AS event FROM nation"


def month_events(spark, root):
    n = read_table(spark, root, "nation", ["n_nationkey", "n_name"])
    return n.select(F.add_months(F.lit("1995-01-01").cast("date"), (2 * F.col("n_nationkey")).cast("int")).alias("mo"),
                    F.col("n_name").alias("event"))


@register("register_calendar", _r(f"""SELECT x.*, coalesce(e.event, '') AS event
FROM (SELECT mo, {SHARES} FROM r GROUP BY mo HAVING count(*) >= {MIN_MONTH}) x LEFT JOIN ({_EVENTS_SQL}) e USING (mo)"""))
def register_calendar(spark, root):
    """Pooled monthly registers with the event label of the month, '' without one."""
    months = RG.register_shares(register_view(spark, root), ["mo"], min_n=MIN_MONTH)
    return TM.label_lookup(months, month_events(spark, root), key="mo")


# The published patterns over the composed messages, which hold civic and thankful phrases;
# some get a closing word about the other side.
_SAID = """SELECT *, text || CASE WHEN msg_id % 7 = 0 THEN ' against the radical left' WHEN msg_id % 11 = 0 THEN ' despite the GOP'
                              ELSE '' END AS said FROM m WHERE party IS NOT NULL"""


def _published(p: str) -> str:
    return f"regexp_matches(lower(said), '{RG.portable_re2(p)}')"


@register("published_registers", O.with_views(f"""SELECT party, topic, {SHARES} FROM (
  SELECT *, {_tones(['joy'], ['anger', 'disgust'])}, {_published(K.CIVIC)} AS has_civic, {_published(K.GRATITUDE)} AS has_thanks,
         coalesce(map {{'Democrat': {_published(K.DEM_OUT)}, 'Republican': {_published(K.REP_OUT)}}}[party], false) AS about_others
  FROM ({_SAID}) y) x GROUP BY party, topic""", m=O.MSGS))
def published_registers(spark, root):
    """H1-H3 with the published civic, gratitude and out-group patterns, by group and topic."""
    i = F.col("msg_id")
    d = msgs(spark, root).filter(F.col("party").isNotNull()).withColumn("text", F.concat(
        "text", F.when(i % 7 == 0, " against the radical left").when(i % 11 == 0, " despite the GOP").otherwise("")))
    return RG.register_shares(RG.add_registers(d, pos=["joy"], neg=["anger", "disgust"]), ["party", "topic"])


_MONTH_REG = f"""SELECT mo, count(*) FILTER (warm AND has_civic) / count(*) AS civic,
       count(*) FILTER (hostile AND about_others) / count(*) AS polarizing FROM r GROUP BY mo HAVING count(*) >= {MIN_MONTH}"""


@register("register_top_months", _r(f"""SELECT ranked_by, mo, strftime(mo, '%b %Y') AS label, rank, ROUND(civic, 6) AS civic,
       ROUND(polarizing, 6) AS polarizing
FROM (SELECT 'civic' AS ranked_by, mo, row_number() OVER (ORDER BY civic DESC, mo) AS rank, civic, polarizing FROM ({_MONTH_REG}) c
      UNION ALL
      SELECT 'polarizing', mo, row_number() OVER (ORDER BY polarizing DESC, mo), civic, polarizing FROM ({_MONTH_REG}) c) x
WHERE rank <= {TOP_MONTHS}"""))
def register_top_months(spark, root):
    """The top months by civic share and by polarizing share."""
    cal_ = RG.register_shares(register_view(spark, root), ["mo"], min_n=MIN_MONTH).select("mo", "civic", "polarizing")
    out = None
    for col in ("civic", "polarizing"):
        # the calendar has one row per month: a small, bounded table
        w = Window.orderBy(F.desc(col), "mo")
        top = cal_.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= TOP_MONTHS)
        top = top.select(F.lit(col).alias("ranked_by"), "mo", cal.month_label("mo").alias("label"), "rank",
                         "civic", "polarizing")
        out = top if out is None else out.unionByName(top)
    return out


def _dist_sql(key: str, min_n: int) -> str:
    em = K.EMOTIONS
    conds = ", ".join(f"avg(CASE WHEN party = 'Democrat' THEN {e} END) - avg(CASE WHEN party = 'Republican' THEN {e} END) AS gap_{e}"
                      for e in em)
    sq = " + ".join(f"gap_{e} * gap_{e}" for e in em)
    big = "CASE " + " ".join(
        f"WHEN abs(gap_{e}) = greatest({', '.join(f'abs(gap_{x})' for x in em)}) THEN '{e}'" for e in em) + " END"
    sign = "CASE " + " ".join(
        f"WHEN abs(gap_{e}) = greatest({', '.join(f'abs(gap_{x})' for x in em)}) THEN gap_{e}" for e in em) + " END"
    gaps = ", ".join(f"ROUND(gap_{e}, 6) AS gap_{e}" for e in em)
    return _r(f"""SELECT {key}, ROUND(sqrt({sq}), 6) AS distance, {big} AS biggest_gap,
       CASE WHEN ({sign}) > 0 THEN 'Democrats higher' ELSE 'Republicans higher' END AS gap_sign, {gaps}
FROM (SELECT {key}, {conds} FROM r GROUP BY {key}
      HAVING count(CASE WHEN party = 'Democrat' THEN 1 END) >= {max(min_n, 1)}
         AND count(CASE WHEN party = 'Republican' THEN 1 END) >= {max(min_n, 1)}) g""")


@register("profile_distance", _dist_sql("year", 0))
def profile_distance(spark, root):
    """H5: Euclidean distance between the two groups' mean emotion profiles, by year."""
    return RG.profile_distance(scored_view(spark, root), "year")


@register("profile_distance_month", _dist_sql("mo", MIN_PROFILE))
def profile_distance_month(spark, root):
    """H6: the same by month, both groups with at least a floor of messages."""
    return RG.profile_distance(scored_view(spark, root), "mo", min_n=MIN_PROFILE)


def _exemplar_sql() -> str:
    em = K.EMOTIONS
    dmax = "CASE " + " ".join(f"WHEN gap_{e} = greatest({', '.join(f'gap_{x}' for x in em)}) THEN '{e}'" for e in em) + " END"
    rmin = "CASE " + " ".join(f"WHEN gap_{e} = least({', '.join(f'gap_{x}' for x in em)}) THEN '{e}'" for e in em) + " END"
    chosen = "CASE " + " ".join(f"WHEN p.emo = '{e}' THEN c.{e}" for e in em) + " END"
    lo, hi = K.EXEMPLAR_LEN
    conds = ", ".join(f"avg(CASE WHEN party = 'Democrat' THEN {e} END) - avg(CASE WHEN party = 'Republican' THEN {e} END) AS gap_{e}"
                      for e in em)
    tidy0 = "trim(regexp_replace(replace(regexp_replace(t, 'https?://\\S+', '', 'g'), '&amp;', '&'), '\\s+', ' ', 'g'))"
    return _r(f"""
, g AS (SELECT mo, {conds} FROM r GROUP BY mo
        HAVING count(CASE WHEN party = 'Democrat' THEN 1 END) >= {MIN_PROFILE}
           AND count(CASE WHEN party = 'Republican' THEN 1 END) >= {MIN_PROFILE}),
picks AS (SELECT mo, 'Democrat' AS grp, {dmax} AS emo FROM g UNION ALL SELECT mo, 'Republican', {rmin} FROM g),
flags AS (SELECT *, starts_with(text, 'RT @') AS passed_on, length(text) AS size,
                 length(array_to_string(string_split_regex(text, 'https?://\\S+'), '')) AS bare FROM r),
cand AS (SELECT * FROM flags WHERE CASE WHEN passed_on THEN false WHEN bare < {K.EXEMPLAR_MIN_NO_LINK} THEN false
                                        ELSE size >= {lo} AND size <= {hi} END),
best AS (SELECT c.mo, p.grp AS party, p.emo, arg_max(c.msg_id, ({chosen}, -c.msg_id)) AS id,
                max({chosen}) AS s
         FROM cand c JOIN picks p ON c.mo = p.mo AND c.party = p.grp GROUP BY 1, 2, 3),
sel AS (SELECT b.*, cu.c_name AS who0, dt.text AS t FROM best b JOIN orders o ON o.o_orderkey = b.id
        JOIN customer cu ON cu.c_custkey = o.o_custkey
        JOIN ({O.NUMBERED}) dt ON dt.k = b.id % (SELECT count(*) FROM documents)),
tid AS (SELECT *, {tidy0} AS t1 FROM sel)
SELECT mo, party, emo, regexp_replace(who0, '\\s+[DRI]-[A-Z]{{2}}$', '') AS who,
       CASE WHEN length(t1) <= {K.TIDY_MAX} THEN t1 ELSE regexp_replace(substr(t1, 1, {K.TIDY_CUT}), ' [^ ]*$', '') || '…' END AS text,
       ROUND(s, 2) AS score FROM tid""").replace(")\n\n, g AS", "),\ng AS")


@register("exemplars", _exemplar_sql())
def exemplars(spark, root):
    """Per month, each group's most over-expressed emotion and its top message."""
    r = scored_view(spark, root, also={"text_ok": RG.exemplar_text_ok("text")})
    won = winners_with_text(spark, root, RG.exemplars(r, min_n=MIN_PROFILE), "id")  # two rows a month
    return won.select("mo", "party", "emo", TX.clean_display_name(F.col("author_name")).alias("who"),
                      TX.tidy_text("text").alias("text"), F.round("score", 2).alias("score"))


# ---- scoring -----------------------------------------------------------------------------

def _docs(spark, root):
    return read_table(spark, root, "documents", ["doc_id", "text", "lang"]).withColumnRenamed("doc_id", "msg_id")


DOCS = "SELECT doc_id AS msg_id, text, lang FROM documents"
LABELS = list(K.EMOTIONS) + list(K.SENTIMENTS)


@register("lexicon_scores", O.with_views(
    "SELECT msg_id, lang, " + ", ".join(f"ROUND({c}, 6) AS {c}" for c in LABELS) + " FROM s",
    s=O.lexicon_sql(DOCS)))
def lexicon_scores(spark, root):
    """M1/M2/M5/C17: the SQL lexicon scorer -- 11 sigmoid emotions, 3 softmax sentiments."""
    return SC.lexicon_scores(_docs(spark, root)).drop("text")


@register("score_record", O.with_views(
    "SELECT msg_id, " + ", ".join(f"ROUND({c}, 4) AS {c}" for c in LABELS) + ", ROUND(anger, 4) > 0.5 AS angry FROM s",
    s=O.lexicon_sql(DOCS)))
def score_record(spark, root):
    """M3: 4-dp score record with the angry flag from the rounded value."""
    return SC.score_record(SC.lexicon_scores(_docs(spark, root)).drop("text", "lang"))


_STRUCTS = ", ".join(f"{{'label': '{e}', 'p': {e}, 'i': {i}}}" for i, e in enumerate(K.EMOTIONS))


@register("label_report", O.with_views(f"""SELECT msg_id, rank, label, ROUND(p, 6) AS p FROM (
  SELECT msg_id, label, p, row_number() OVER (PARTITION BY msg_id ORDER BY p DESC, i) AS rank
  FROM (SELECT msg_id, x.label AS label, x.p AS p, x.i AS i FROM (SELECT msg_id, unnest([{_STRUCTS}]) AS x FROM s) u) v
  WHERE p >= 0.1) z""", s=O.lexicon_sql(DOCS)))
def label_report(spark, root):
    """M7: per text, the emotions at or above 0.1, highest first, one row each."""
    s = SC.lexicon_scores(_docs(spark, root))
    rep = s.select("msg_id", F.posexplode(SC.report_labels(s)).alias("pos", "x"))
    return rep.select("msg_id", (F.col("pos") + 1).cast("long").alias("rank"), F.col("x.label").alias("label"), F.col("x.p").alias("p"))


@register("label_compare", O.with_views(
    "SELECT " + ", ".join(f"ROUND(avg({c}), 6) AS mean_{c}" for c in K.SENTIMENTS) + ", "
    + ", ".join(f"ROUND(avg(CAST(top = '{c}' AS INTEGER)), 6) AS top_{c}" for c in K.SENTIMENTS)
    + " FROM (SELECT *, CASE " + " ".join(
        f"WHEN {c} = greatest({', '.join(K.SENTIMENTS)}) THEN '{c}'" for c in K.SENTIMENTS) + " END AS top FROM s) t",
    s=O.lexicon_sql(DOCS)))
def label_compare(spark, root):
    """M6: mean probability per sentiment label and its arg-max share."""
    return SC.model_comparison(SC.lexicon_scores(_docs(spark, root)), K.SENTIMENTS)


_CORR = ["anger", "negative", "disgust", "joy"]


@register("score_correlations", O.with_views(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, ROUND(corr({a}, {b}), 6) AS r FROM s"
    for i, a in enumerate(_CORR) for b in _CORR[i + 1:]), s=O.lexicon_sql(DOCS)))
def score_correlations(spark, root):
    """Pearson correlation between score columns, every pair, one pass."""
    return SC.correlations(SC.lexicon_scores(_docs(spark, root)), _CORR)


@register("model_scores", O.with_views(
    "SELECT msg_id, " + ", ".join(f"ROUND({c}, 6) AS {c}" for c in LABELS) + " FROM s", s=O.lexicon_sql(DOCS)))
def model_scores(spark, root):
    """M1/M2/M4: Python-model path -- emotions and sentiment in one pass of Arrow batches."""
    return SC.score_batches(_docs(spark, root), SC.lexicon_model(), [(K.EMOTIONS, True), (K.SENTIMENTS, False)])


@register("sample_repeatable", O.with_views(
    "SELECT msg_id, lang FROM d ORDER BY md5('7:' || CAST(msg_id AS VARCHAR)), msg_id LIMIT 50", d=DOCS))
def sample_repeatable(spark, root):
    """A repeatable fixed-size sample (the top-k of a seeded hash of the id)."""
    return SC.repeatable_sample(_docs(spark, root), 50, seed=7).select("msg_id", "lang")


@register("top_angry_texts", O.with_views("""SELECT msg_id, ROUND(anger, 6) AS anger FROM s
ORDER BY anger DESC, msg_id LIMIT 12""", s=O.lexicon_sql(DOCS)))
def top_angry_texts(spark, root):
    """The twelve texts the scorer finds angriest (ties by id)."""
    s = SC.lexicon_scores(_docs(spark, root)).select("msg_id", "anger")
    return s.orderBy(F.desc("anger"), "msg_id").limit(12)


# ---- text functions over whole documents (C17, C19, C22) ----------------------------------

@register("normalise_text", O.with_views(r"""SELECT msg_id,
       trim(regexp_replace(regexp_replace(text, '@[\p{L}\p{N}_]+', '@user', 'g'), 'https?://\S+', 'http', 'g')) AS text
FROM d""", d=DOCS))
def normalise_text(spark, root):
    """The classifier input form of every whole document."""
    return _docs(spark, root).select("msg_id", TX.model_input("text").alias("text"))


@register("tidy_texts", O.with_views(f"""SELECT msg_id,
       CASE WHEN length(t1) <= {K.TIDY_MAX} THEN t1
            ELSE regexp_replace(substr(t1, 1, {K.TIDY_CUT}), ' [^ ]*$', '') || '…' END AS text
FROM (SELECT msg_id, trim(regexp_replace(replace(regexp_replace(text, 'https?://\\S+', '', 'g'), '&amp;', '&'),
                                         '\\s+', ' ', 'g')) AS t1 FROM d) x""", d=DOCS))
def tidy_texts(spark, root):
    """Links dropped, entities unescaped, spaces collapsed, cut at a word edge."""
    return _docs(spark, root).select("msg_id", TX.tidy_text("text").alias("text"))


@register("text_tokens", O.with_views(
    "SELECT msg_id, len(t) AS n_tokens, array_to_string(list_sort(t), ' ') AS tokens FROM (SELECT msg_id, "
    + _TOKENS_SQL + " AS t FROM d) x", d=DOCS))
def text_tokens(spark, root):
    """The distinct tokens of every whole document (sorted, space-joined) and their number."""
    t = _docs(spark, root).select("msg_id", TX.tokens("text").alias("t"))
    return t.select("msg_id", F.size("t").cast("long").alias("n_tokens"),
                    F.array_join(F.array_sort("t"), " ").alias("tokens"))
