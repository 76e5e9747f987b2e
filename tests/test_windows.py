"""Weekly windows from event-time state: closed, open and late rows."""
import datetime as dt
import os
import tempfile

import pandas as pd
import pytest

from tonekit.streaming import windows as W


@pytest.fixture
def place():
    d = tempfile.mkdtemp(prefix="tonekit-windows-")
    os.makedirs(os.path.join(d, "in"))
    return os.path.join(d, "in"), os.path.join(d, "out")


def put(src, name, days, party="D", anger=None):
    ts = pd.Series([None if x is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=x) for x in days], dtype="datetime64[us]")
    pd.DataFrame({"ts": ts, "party": pd.Series([party] * len(days), dtype="string"),
                  "anger": [0.25 + 0.5 * (i % 2) for i in range(len(days))] if anger is None else anger}).to_parquet(
        os.path.join(src, name), coerce_timestamps="us")


def kinds(spark, out):
    rows = [(r.kind, str(r.wk), r.grp, r.n) for r in W.closed_and_late(spark, out).collect()]
    return sorted(rows, key=str) + sorted((("open", str(r.wk), r.grp, r.n) for r in W.open_weeks(spark, out).collect()), key=str)


def test_weeks_close_once_and_late_rows_go_aside(spark, place):
    src, out = place
    put(src, "a.parquet", [0, 1, 8, None])
    W.run_weekly_windows(spark, src, lambda x: x, out, delay="3 days")
    assert kinds(spark, out) == [("open", "2024-01-01", "D", 2), ("open", "2024-01-08", "D", 1)]
    W.run_weekly_windows(spark, src, lambda x: x, out, delay="3 days")  # nothing new, nothing changes
    assert kinds(spark, out) == [("open", "2024-01-01", "D", 2), ("open", "2024-01-08", "D", 1)]
    put(src, "b.parquet", [2, 10])  # the watermark reaches 8 January with this batch: the second day still counts
    W.run_weekly_windows(spark, src, lambda x: x, out, delay="3 days")
    assert kinds(spark, out) == [("closed", "2024-01-01", "D", 3), ("open", "2024-01-08", "D", 2)]
    put(src, "c.parquet", [3, 4, 11])
    put(src, "d.parquet", [5], party=None)  # late as well, of a group that had no open week
    W.run_weekly_windows(spark, src, lambda x: x, out, delay="3 days")
    assert kinds(spark, out) == sorted([("closed", "2024-01-01", "D", 3), ("late", "2024-01-01", "D", 2),
                                        ("late", "2024-01-01", None, 1)], key=str) + [("open", "2024-01-08", "D", 3)]
    put(src, "e.parquet", [60])  # closes what is open
    W.run_weekly_windows(spark, src, lambda x: x, out, delay="3 days")
    got = {(str(r.wk), r.party): (r.n, r.n_closed, r.n_open, r.n_late) for r in W.all_weeks(spark, out).collect()}
    assert got == {("2024-01-01", "D"): (5, 3, 0, 2), ("2024-01-01", None): (1, 0, 0, 1), ("2024-01-08", "D"): (3, 3, 0, 0),
                   ("2024-02-26", "D"): (1, 0, 1, 0)}


def test_sums_survive_a_killed_batch(spark, place):
    src, out = place
    put(src, "a.parquet", [0, 1, 2])
    W.run_weekly_windows(spark, src, lambda x: x, out, delay="1 days")
    put(src, "b.parquet", [3, 30])

    def dies(df):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        W.run_weekly_windows(spark, src, dies, out, delay="1 days")
    W.run_weekly_windows(spark, src, lambda x: x, out, delay="1 days")
    assert kinds(spark, out) == [("closed", "2024-01-01", "D", 4), ("open", "2024-01-29", "D", 1)]


def test_null_scores_count_as_rows_only(spark, place):
    src, out = place
    put(src, "a.parquet", [0, 1, 2], anger=[0.9, None, 0.1])
    W.run_weekly_windows(spark, src, lambda x: x, out)
    r = W.all_weeks(spark, out).first()
    assert (r.n, r.anger, r.share_angry) == (3, 0.5, 0.5)
