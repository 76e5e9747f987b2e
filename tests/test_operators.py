"""Operator checks against brute-force oracles on literal or random rows."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonekit.operators import battery as B
from tonekit.operators import enrich as EN
from tonekit.operators import link as L
from tonekit.operators import panel as P
from tonekit.operators import rates as R
from tonekit.operators import registers as RG
from tonekit.operators import series as S


def test_battery_threshold_and_deviation_invariant(spark):
    rows = [(2020, "a", 0.5), (2020, "a", 0.9), (2020, "b", 0.1), (2021, "a", 0.2), (2021, "b", 0.7), (2021, "b", 0.8)]
    df = spark.createDataFrame(rows, "year int, k string, anger double")
    cells = B.mean_battery(df, ["year", "k"], means=("anger",), min_n=1)
    got = {(r.year, r.k): r.share_angry for r in cells.collect()}
    assert got[(2020, "a")] == 0.5          # 0.5 itself is not angry (strict >)
    dev = B.deviation_within(cells, "year").toPandas()
    for _, g in dev.groupby("year"):
        assert abs((g.anger_dev * g.n).sum()) < 1e-12   # n-weighted deviations cancel


def test_dedup_first_keeps_first_corpus_before_filters(spark):
    rows = [(1, "b", "late"), (1, "a", "early"), (2, "b", "only"), (3, "a", "x"), (3, "a", "y")]
    df = spark.createDataFrame(rows, "id int, source_corpus string, text string")
    out = {r.id: (r.source_corpus, r.text) for r in EN.dedup_first(df, "id", ["source_corpus"]).collect()}
    assert out[1] == ("a", "early") and out[2] == ("b", "only") and out[3] in {("a", "x"), ("a", "y")}
    again = {r.id: (r.source_corpus, r.text) for r in
             EN.dedup_first(df.repartition(4), "id", ["source_corpus"]).collect()}
    assert again == out


def test_greedy_peaks_spacing_21_allowed_20_rejected(spark):
    base = dt.date(2020, 1, 6)
    rows = [(base, 1.0), (base + dt.timedelta(days=21), 0.9), (base + dt.timedelta(days=41), 0.8),
            (base + dt.timedelta(days=70), 0.7), (base + dt.timedelta(days=7), 0.95)]
    df = spark.createDataFrame(rows, "wk date, excess double")
    kept = sorted(r.wk for r in S.greedy_peaks(df, k=40).collect())
    assert kept == [base, base + dt.timedelta(days=21), base + dt.timedelta(days=70)]
    assert len(S.greedy_peaks(df, k=2).collect()) == 2


def test_rolling_windows_match_pandas(spark):
    rng = np.random.default_rng(3)
    wk = pd.date_range("2020-01-06", periods=80, freq="7D").date
    x = rng.normal(size=80)
    x[[5, 6, 40]] = np.nan
    pdf = pd.DataFrame({"wk": wk, "x": x})
    df = spark.createDataFrame([(w, None if np.isnan(v) else float(v)) for w, v in zip(wk, x)], "wk date, x double")
    got = df.select("wk", S.rolling_median("x").alias("m"), S.rolling_std("x").alias("s")).orderBy("wk").toPandas()
    exp_m = pdf.x.rolling(13, center=True, min_periods=5).median()
    exp_s = pdf.x.rolling(52, center=True, min_periods=20).std()
    np.testing.assert_allclose(got.m.astype(float), exp_m, rtol=1e-12, equal_nan=True)
    np.testing.assert_allclose(got.s.astype(float), exp_s, rtol=1e-9, equal_nan=True)


def _cluster_ols_numpy(y, X, groups, w=None):
    w = np.ones(len(y)) if w is None else w
    Xw = X * np.sqrt(w)[:, None]
    yw = y * np.sqrt(w)
    XtX_inv = np.linalg.inv(Xw.T @ Xw)
    beta = XtX_inv @ Xw.T @ yw
    e = yw - Xw @ beta
    meat = np.zeros((X.shape[1], X.shape[1]))
    ug = np.unique(groups)
    for g in ug:
        s = (Xw[groups == g] * e[groups == g, None]).sum(0)
        meat += np.outer(s, s)
    n, k, G = len(y), X.shape[1], len(ug)
    V = G / (G - 1) * (n - 1) / (n - k) * XtX_inv @ meat @ XtX_inv
    return beta, np.sqrt(np.diag(V))


def test_clustered_slope_matches_dummy_regression(spark):
    rng = np.random.default_rng(11)
    n = 400
    cl = rng.integers(0, 25, n)
    cat = rng.integers(0, 3, n)
    x = rng.normal(50, 10, n) + cl
    y = 0.02 * x + 0.3 * cat + rng.normal(0, 1, n) + 0.1 * cl
    pdf = pd.DataFrame({"g": 1, "y": y, "x": x, "c": cl, "cat": cat})
    df = spark.createDataFrame(pdf)
    raw = P.clustered_slope(df, "g", "y", "x", "c").first()
    b, se = _cluster_ols_numpy(y, np.column_stack([np.ones(n), x]), cl)
    assert abs(raw.slope - b[1]) < 1e-10 and abs(raw.se - se[1]) < 1e-10
    adj = P.clustered_slope(df, "g", "y", "x", "c", absorb="cat").first()
    D = np.column_stack([np.ones(n), (cat == 1).astype(float), (cat == 2).astype(float), x])
    b2, se2 = _cluster_ols_numpy(y, D, cl)
    assert abs(adj.slope - b2[3]) < 1e-10 and abs(adj.se - se2[3]) < 1e-10


def test_fixed_effects_wls_matches_dummy_regression(spark):
    rng = np.random.default_rng(5)
    rows = []
    for m in range(30):
        for t in range(6):
            rows.append((m, rng.normal(40 + t, 3) + m, rng.normal(), int(rng.integers(1, 50))))
    pdf = pd.DataFrame(rows, columns=["m", "age", "dev", "n"])
    res = P.within_unit_slope(spark.createDataFrame(pdf), "m", "dev", "age", scale=1.0).first()
    D = np.column_stack([np.ones(len(pdf))] + [(pdf.m == k).astype(float) for k in range(1, 30)] + [pdf.age])
    b, se = _cluster_ols_numpy(pdf.dev.values, D, pdf.m.values, w=pdf.n.values.astype(float))
    assert abs(res.slope_per_decade - b[-1]) < 1e-10 and abs(res.se - se[-1]) < 1e-10


def test_spearman_matches_pandas(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 20, 200).astype(float)
    b = a + rng.normal(0, 5, 200)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b}))
    rho = P.spearman(df, "a", "b").first().rho
    ra, rb = pd.Series(a).rank(method="average"), pd.Series(b).rank(method="average")
    assert abs(rho - np.corrcoef(ra, rb)[0, 1]) < 1e-12


def test_profile_distance_ties_and_sign(spark):
    rows = [("k", "Democrat", 0.5, 0.2), ("k", "Republican", 0.3, 0.4)]
    df = spark.createDataFrame(rows, "key string, party string, e1 double, e2 double")
    r = RG.profile_distance(df, "key", scores=["e1", "e2"]).first()
    assert r.biggest_gap == "e1" and r.gap_sign == "Democrats higher"    # |0.2| ties |-0.2|: first wins
    assert abs(r.distance - np.sqrt(0.08)) < 1e-12
    one_sided = spark.createDataFrame([("j", "Democrat", 0.1, 0.1)], "key string, party string, e1 double, e2 double")
    assert RG.profile_distance(one_sided, "key", scores=["e1", "e2"]).count() == 0


def test_latest_skips_nulls(spark):
    rows = [(1, dt.datetime(2020, 1, 1), 1, "Old"), (1, dt.datetime(2021, 1, 1), 2, None)]
    df = spark.createDataFrame(rows, "a int, ts timestamp_ntz, msg_id int, name string")
    assert R.latest(df, "a", ["name"]).first().name == "Old"


def test_rate_lookup_member_first_then_cells(spark):
    cells = spark.createDataFrame([("D", "e1", "b1", 100, 0.2), ("D", "e1", "b2", 300, 0.6)],
                                  "party string, era string, band string, n long, share_angry double")
    mcells = spark.createDataFrame([("Ann", "e1", "b1", 10, 0.9)],
                                   "name string, era string, band string, n long, share_angry double")
    req = spark.createDataFrame([("r1", "D", None, None, "Ann"), ("r2", "D", None, "b2", "Ann"),
                                 ("r3", None, None, None, None), ("r4", "R", None, None, None)],
                                "req string, party string, era string, band string, name string")
    out = {r.req: (r.p, r.n, r.description) for r in R.rate_lookup(req, cells, mcells).collect()}
    assert out["r1"] == (0.9, 10, "Ann")
    assert out["r2"][1] == 300 and abs(out["r2"][0] - 0.6) < 1e-12          # member has no b2 cell -> group cells
    assert out["r3"][1] == 400 and out["r3"][2] == "nothing known"
    assert out["r4"] == (None, 0, "no data for that combination")


def test_name_parser_forms(spark):
    rows = [("h1", "Sánchez, Linda"), ("h2", "Joe Barton R-TX"), ("h3", "Kean, Jr."), ("h4", "Jen Van Orden"),
            ("h5", "Cher"), ("h6", "Daniel S. Goldman")]
    df = spark.createDataFrame(rows, "author_handle string, author_name string")
    c = L.name_candidates(df).orderBy("author_handle", "rank").collect()
    got = {}
    for r in c:
        got.setdefault(r.author_handle, []).append((r.first, r.last))
    assert got["h1"] == [("linda", "sanchez")]
    assert got["h2"] == [("joe", "barton")]
    assert "h3" not in got          # the suffix goes first, leaving one word: no candidates
    assert got["h4"] == [("jen", "van orden"), ("jen", "orden")]
    assert "h5" not in got
    assert got["h6"] == [("daniel", "s goldman"), ("daniel", "goldman")]


def test_mode_ties_smallest_and_majority(spark):
    rows = [("h", "B", "NY", "Senate"), ("h", "A", "NY", "other"), ("h", None, None, None),
            ("g", None, None, "House")]
    df = spark.createDataFrame(rows, "author_handle string, author_name string, state string, chamber string")
    out = {r.author_handle: r for r in L.author_summary(df).collect()}
    assert out["h"].author_name == "A" and out["h"].state == "NY" and out["h"].is_congress is False
    assert out["g"].author_name is None and out["g"].is_congress is True


def test_network_edges_from_literal_texts(spark):
    from tonekit.operators import network as N

    rows = [  # (msg_id, author, handle, party, text, anger, ts)
        (1, 1, "RepA", "Democrat", "RT @repb: x", 0.9),
        (2, 1, "RepA", "Democrat", "RT @RepB: y", 0.1),
        (3, 1, "RepA", "Democrat", "RT @repB: z", 0.2),
        (4, 2, "RepB", "Republican", " .@RepA .@repa and .@RepC", 0.8),
        (5, 2, "RepB", "Republican", "x.@RepA no match", 0.8),
        (6, 2, "RepB", "Republican", "@RepA hi", 0.3),
        (7, 3, "RepC", "Democrat", ".@RepA first", 0.6),
        (8, 2, "RepB", "Republican", ".@RepA again", 0.7),
    ]
    df = spark.createDataFrame([r + (dt.datetime(2020, 1, 1, 0, 0, i),) for i, r in enumerate(rows)],
                               "msg_id long, author long, handle string, party string, text string, anger double, "
                               "ts timestamp_ntz").withColumn("year", F.year("ts"))
    df = df.withColumn("author_name", F.concat(F.lit("Name "), F.col("author").cast("string"))).withColumn(
        "state", F.lit("NY"))
    alias = N.aliases(df)
    rt = {(r.src, r.dst): r.n for r in N.retweet_edges(df, alias, exclude_years=[]).collect()}
    assert rt == {(1, 2): 3}                                   # handle matched case-insensitively
    dot = {(r.src, r.dst): r.n for r in N.dot_edges(df, alias).collect()}
    assert dot == {(2, 1): 3, (2, 3): 1, (3, 1): 1}            # 'x.@A' is no call-out; a repeat counts twice
    nodes = N.members(df)
    edges = N.member_edges(N.dot_edges(df, alias), nodes, min_n=1)
    cross = {(r.src, r.dst): r.is_cross for r in edges.collect()}
    assert cross == {(2, 1): True, (2, 3): True, (3, 1): False}
    kinds = {(r.kind, r.relation): r.n for r in
             N.mention_kinds(df.withColumn("angry", (F.col("anger") > 0.5).cast("int")), alias, nodes).collect()}
    assert kinds[("reply", "cross")] == 1 and kinds[("callout", "cross")] == 2 and kinds[("mention", "cross")] == 1


PEOPLE = "bioguide string, first string, last string, nickname string, official_full string, states array<string>, last_term_end string"
AUTHORS = "author_handle string, author_name string, state string"
HANDLES = "handle string, bioguide string, snapshot string"


def test_link_empty_state_is_unknown(spark):
    people = spark.createDataFrame([("P1", "Ana", "Kim", None, None, ["TX"], "2020-01-01"),
                                    ("P2", "Ana", "Kim", None, None, ["CA", "TX"], "2022-01-01"),
                                    ("P3", "Bo", "Diaz", None, None, ["NY"], "2004-12-31"),
                                    ("P4", "Cy", "Diaz", None, None, ["NY"], "2010-01-01")], PEOPLE)
    authors = spark.createDataFrame([("a", "Ana Kim", ""), ("b", "Ana Kim", None), ("c", "Ana Kim", "TX"), ("d", "Ana Kim", "CA"),
                                     ("e", "Ana Kim", "NY"), ("f", "Someone Diaz", "NY"), ("g", "Someone Diaz", "")], AUTHORS)
    out = {r.author_handle: (r.bioguide, r.match_method) for r in
           L.link_authors(authors, people, spark.createDataFrame([], HANDLES)).collect()}
    assert out == {"a": ("P2", "name"), "b": ("P2", "name"), "c": ("P2", "name"), "d": ("P2", "name"), "e": (None, None),
                   "f": ("P4", "lastname+state"), "g": (None, None)}


def test_link_joins_grow_with_the_authors(spark):
    """All authors and people share one name: no join may pair them."""
    def joined(n):
        people = spark.range(n).select(F.format_string("P%09d", "id").alias("bioguide"), F.lit("Ana").alias("first"),
                                       F.lit("Kim").alias("last"), F.lit(None).cast("string").alias("nickname"),
                                       F.lit(None).cast("string").alias("official_full"), F.array(F.lit("TX")).alias("states"),
                                       F.lit("2020-01-01").alias("last_term_end"))
        authors = spark.range(n).select(F.format_string("h%d", "id").alias("author_handle"), F.lit("Ana Kim").alias("author_name"),
                                        F.when(F.col("id") % 2 == 0, "TX").alias("state"))
        out = L.link_authors(authors, people, spark.createDataFrame([], HANDLES))
        out.count()
        assert out.filter("bioguide = 'P000000000'").count() == n
        plan = out._jdf.queryExecution().executedPlan()
        out.collect()
        sizes, todo = [], [plan]
        while todo:
            p = todo.pop()
            name = p.nodeName()
            if "Join" in name and p.metrics().contains("numOutputRows"):
                sizes.append(p.metrics().apply("numOutputRows").value())
            if name.startswith("AdaptiveSparkPlan"):
                todo.append(p.executedPlan())
            elif "QueryStage" in name:
                todo.append(p.plan())
            kids = p.children()
            todo += [kids.apply(i) for i in range(kids.size())]
        return max(sizes)

    assert joined(2000) <= 12 * joined(200)


def test_long_handles_keep_their_number(spark, monkeypatch):
    from tonekit.plans import enrich_queries as Q

    rows = [(1, "U1234567890123456", "n", "x", "Senate", "NY", dt.datetime(2024, 1, 1), "t", "click", 0.5, "a")]
    df = spark.createDataFrame(rows, "msg_id long, author_handle string, author_name string, party string, chamber string, "
                                     "state string, ts timestamp_ntz, text string, topic string, anger double, source_corpus string")
    monkeypatch.setattr(Q, "corpus", lambda spark, root: df)
    assert Q.corpus_authors(spark, "").first().bioguide == "P1234567890123456"


def test_fold_covers_every_compatibility_letter(spark):
    import unicodedata

    from tonekit.functions.text import fold_ascii

    names = ["Ｊｏｅ", "𝓙𝓸𝓮", "Jose\u0301", "Œuvre ﬁne ﬄ", "Ⓐⓑ ㎏", "İstanbul", "O’Neil-Smith 3rd", "", "Łódź", "ﬀ", "Ǆ"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, s string")
    got = [r.f for r in df.select("i", fold_ascii("s").alias("f")).orderBy("i").collect()]
    want = []
    for n in names:
        plain = unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode().lower()
        want.append("".join(c for c in plain if c == " " or "a" <= c <= "z").strip())
    assert got == want and got[0] == got[1] == "joe"


def test_normal_p_is_erfc(spark):
    import math

    zs = [0.0, 1e-9, 0.3, 1.0, 1.96, 2.5, 2.8284, 2.83, 4.0, 8.0, 30.0, -1.5]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for r in df.select("z", P.normal_p("z").alias("p")).collect():
        assert abs(r.p - math.erfc(abs(r.z) / math.sqrt(2))) <= 1e-12 * max(1e-3, math.erfc(abs(r.z) / math.sqrt(2))) + 1e-300
    assert spark.createDataFrame([(None,)], "z double").select(P.normal_p("z").alias("p")).first().p is None


def test_median_and_positions(spark):
    rng = np.random.default_rng(8)
    for n in (1, 2, 7, 500):
        x = rng.integers(0, 40, n) / 4.0
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
        assert P.exact_median(df, "x").first()["median"] == float(np.median(x))
        got = {r.x: (r.c, r.before) for r in P.positions(df, "x", buckets=8).collect()}
        assert got == {float(v): (int((x == v).sum()), int((x < v).sum())) for v in set(x)}


@pytest.mark.parametrize("weight", [None, "w"])
@pytest.mark.parametrize("absorb", [None, "cat", "c"])
def test_slopes_do_not_depend_on_where_x_begins(spark, weight, absorb):
    rng = np.random.default_rng(8)
    n = 600
    rows = [("g", float(rng.integers(0, 40)), float(rng.normal()), int(i % 17), int(rng.integers(0, 3)), float(rng.integers(1, 5)))
            for i in range(n)]
    df = spark.createDataFrame(rows, "g string, x double, y double, c int, cat int, w double").repartition(4)
    far = df.withColumn("x", F.col("x") + 1e6).withColumn("y", F.col("y") + 0)
    a, b = (P.clustered_slope(d, "g", "y", "x", "c", absorb=absorb, weight=weight).first() for d in (df, far))
    assert a.slope == pytest.approx(b.slope, rel=1e-9, abs=1e-10) and a.se == pytest.approx(b.se, rel=1e-9, abs=1e-10)
    # explicit regression on dummies, centred by hand
    arr = np.array([r[1:] for r in rows], float)
    w = arr[:, 4] if weight else np.ones(n)
    k = {None: np.zeros(n), "cat": arr[:, 3], "c": arr[:, 2]}[absorb]
    x, y = arr[:, 0].copy(), arr[:, 1].copy()
    for v in np.unique(k):
        m = k == v
        x[m] -= np.average(x[m], weights=w[m])
        y[m] -= np.average(y[m], weights=w[m])
    assert a.slope == pytest.approx((w * x * y).sum() / (w * x * x).sum(), rel=1e-10)
