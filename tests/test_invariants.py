"""Relations between result columns that hold in the reference's published tables
(SURVEY §5), checked on our outputs at sf0.01."""
import math

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def q(spark):
    qs = E.queries()
    cache = {}

    def get(name):
        if name not in cache:
            cache[name] = qs[name](spark, SF).toPandas()
        return cache[name]

    return get


def test_year_counts_and_baseline_agree(q, spark):
    by_year = q("year_battery")
    from tonekit.plans.views import analysis_posts

    total = analysis_posts(spark, SF).count()
    assert by_year.n.sum() == total                                   # §5.1 (floor keeps every year here)
    pooled = (by_year.share_angry * by_year.n).sum() / by_year.n.sum()
    from tonekit.operators.battery import mean_battery

    overall = mean_battery(analysis_posts(spark, SF), [], means=("anger",), min_n=0).first().share_angry
    assert abs(pooled - overall) < 1e-5                                # §5.2


@pytest.mark.parametrize("name,within", [("dow_dev", ["year"]), ("season_dev", ["year"]),
                                         ("age_bracket_dev", ["year"]), ("age_party_dev", ["year", "party"])])
def test_deviation_is_value_minus_weighted_mean(q, name, within):
    d = q(name)
    for _, g in d.groupby(within):
        base = (g.anger * g.n).sum() / g.n.sum()
        assert ((g.anger - base) - g.anger_dev).abs().max() < 2e-6      # §5.3 (values rounded to 6 dp)


def test_pvalues_are_normal(q):
    d = q("ols_pvalues")
    for r in d.itertuples():
        assert abs(r.p - math.erfc(abs(r.z) / math.sqrt(2))) < 2e-6     # §5.4


def test_distance_is_gap_norm_and_argmax(q):
    from tonekit.constants import EMOTIONS

    d = q("profile_distance")
    for r in d.itertuples():
        gaps = [getattr(r, f"gap_{e}") for e in EMOTIONS]
        assert abs(math.sqrt(sum(x * x for x in gaps)) - r.distance) < 1e-5   # §5.5
        assert r.biggest_gap == EMOTIONS[max(range(len(gaps)), key=lambda i: (abs(gaps[i]), -i))]


def test_spikes_mondays_spacing_and_driver_rule(q):
    s = q("seismograph")
    wks = sorted(s.wk)
    assert all(w.weekday() == 0 for w in wks)                          # §5.6
    assert all((b - a).days >= 21 for a, b in zip(wks, wks[1:]))
    assert len(wks) <= 40
    for r in s.itertuples():
        exp = "Dem" if r.dem_excess > r.rep_excess + 0.03 else "Rep" if r.rep_excess > r.dem_excess + 0.03 else "both"
        if abs(abs(r.dem_excess - r.rep_excess) - 0.03) > 1e-5:        # away from the (rounded) margin
            assert r.driven_by == exp


def test_night_owls(q):
    d = q("night_day_contrast")
    assert (d.n_night >= 10).all()                                      # §5.7 (floor at test scale)
    assert ((d.nighttime - d.daytime) - d.night_minus_day).abs().max() < 2e-6


def test_party_cells_floor_and_order(q):
    d = q("rate_cells")
    assert (d.n >= 30).all()                                            # §5.8
    ordered = d.sort_values("share_angry", ascending=False, kind="stable").share_angry.tolist()
    assert ordered == sorted(ordered, reverse=True)


def test_final_stretch_and_weeks_are_consistent(q):
    c = q("cycle_week_dev")
    assert (c.weeks_to_election >= 0).all() and (c.weeks_to_election <= 104).all()
    f = q("final_stretch")
    assert f.year.map(lambda y: y % 2 == 0).all()


def test_weekly_stream_weeks_are_mondays_and_counts_match_batch(q, spark):
    s = q("weekly_stream")
    assert all(w.weekday() == 0 for w in s.wk)
    from pyspark.sql import functions as F

    from tonekit.functions import calendar as cal
    from tonekit.plans.views import msgs

    batch = (msgs(spark, SF).groupBy(cal.week_start("ts").alias("wk"), "party").agg(F.count(F.lit(1)).alias("n"))
             .toPandas())
    merged = s.merge(batch, on=["wk", "party"], suffixes=("_stream", "_batch"))
    assert len(merged) == len(s) == len(batch) == 20 and (merged.n_stream == merged.n_batch).all()   # NULL group rows too
