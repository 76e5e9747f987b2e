"""Property tests: operators against straightforward Python versions of the reference's
loops, on random small inputs."""
import datetime as dt

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tonekit.operators import series as S

BASE = dt.date(2020, 1, 6)


def greedy_python(rows, k, gap):
    """The reference loop: by excess descending, skip candidates closer than ``gap``
    days to a kept one, stop at ``k`` (ties here broken by the earlier week)."""
    cand = sorted(rows, key=lambda r: (-r[1], r[0]))
    kept = []
    for wk, _ in cand:
        if any(abs((wk - s).days) < gap for s in kept):
            continue
        kept.append(wk)
        if len(kept) == k:
            break
    return sorted(kept)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 120), st.integers(-50, 50)), min_size=1, max_size=60,
                unique_by=lambda t: t[0]),
       st.integers(1, 10), st.sampled_from([7, 14, 21, 28]))
def test_greedy_peaks_matches_loop(spark, data, k, gap):
    rows = [(BASE + dt.timedelta(days=7 * w), float(v)) for w, v in data]
    df = spark.createDataFrame(rows, "wk date, excess double")
    got = sorted(r.wk for r in S.greedy_peaks(df, k=k, min_gap_days=gap).collect())
    assert got == greedy_python(rows, k, gap)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40), st.integers(0, 1)), min_size=1, max_size=80))
def test_running_totals_match_cumulative_sums(spark, data):
    rows = [(i, a, dt.datetime(2024, 1, 1) + dt.timedelta(days=d, seconds=i), f) for i, (a, d, f) in enumerate(data)]
    df = spark.createDataFrame(rows, "msg_id long, author long, ts timestamp_ntz, angry int")
    got = S.running_totals(df, ["author"], "angry", bucket="week").toPandas().sort_values("msg_id")
    pdf = pd.DataFrame(rows, columns=["msg_id", "author", "ts", "angry"]).sort_values(["author", "ts", "msg_id"])
    pdf["n"] = pdf.groupby("author").cumcount() + 1
    pdf["f"] = pdf.groupby("author").angry.cumsum()
    pdf = pdf.sort_values("msg_id")
    assert got.running_n.tolist() == pdf.n.tolist()
    assert got.running_flagged.tolist() == pdf.f.tolist()
    np.testing.assert_allclose(got.running_share, pdf.f / pdf.n)
