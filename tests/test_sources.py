"""Sources and sinks on small files written by the test itself."""
import json
import os
import tempfile

from pyspark.sql import functions as F

from tonekit.operators import link as L
from tonekit.sources import files as S
from tonekit.streaming.incremental import score_new_files


def _tmp():
    return tempfile.mkdtemp(prefix="tonekit-test-")


def test_nested_json_people_and_terms(spark):
    d = _tmp()
    cur = [{"id": {"bioguide": "A1"}, "bio": {"birthday": "1950-02-01", "gender": "F"},
            "name": {"first": "Linda", "last": "Sánchez", "official_full": "Linda T. Sánchez"},
            "terms": [{"type": "rep", "start": "2003-01-03", "end": "2005-01-03", "state": "CA", "party": "Democrat"},
                      {"type": "rep", "start": "2005-01-04", "end": "2025-01-03", "state": "CA", "party": "Democrat"}]}]
    hist = [{"id": {"bioguide": "B2"}, "bio": {"birthday": "1940-01-01"}, "name": {"first": "Joe", "last": "Barton"},
             "terms": [{"type": "rep", "start": "1985-01-03", "end": "2019-01-03", "state": "TX"}]}]
    for name, data in [("current.json", cur), ("historical.json", hist)]:
        with open(os.path.join(d, name), "w", encoding="utf8") as fh:
            json.dump(data, fh)
    recs = S.read_json_records(spark, [os.path.join(d, "current.json"), os.path.join(d, "historical.json")],
                               schema=L.LEGISLATOR_SCHEMA)
    people = {r.bioguide: r for r in L.people_from_records(recs).collect()}
    assert people["A1"].states == ["CA"] and people["A1"].last_term_end == "2025-01-03"
    assert people["B2"].nickname is None and people["B2"].gender is None
    terms = L.explode_terms(recs)
    assert terms.count() == 3 and terms.filter(F.col("term_party").isNull()).count() == 1


def test_snapshot_order_is_that_of_the_paths(spark):
    """The dated files come first, the current one last, though its name sorts first."""
    d = _tmp()
    with open(os.path.join(d, "social-2019.yaml"), "w") as fh:
        fh.write("- id: {bioguide: A1}\n  social: {twitter: RepLinda}\n- id: {bioguide: B2}\n  social: {}\n")
    with open(os.path.join(d, "legislators-social-media.json"), "w") as fh:
        json.dump([{"id": {"bioguide": "Z9"}, "social": {"twitter": "replinda"}}], fh)
    h = L.snapshot_handles(spark, [os.path.join(d, "social-2019.yaml"), os.path.join(d, "legislators-social-media.json")])
    rows = sorted((r.handle, r.bioguide, r.snapshot) for r in h.collect())
    assert rows == [("RepLinda", "A1", "000000/social-2019.yaml"),
                    ("replinda", "Z9", "000001/legislators-social-media.json")]
    authors = spark.createDataFrame([("replinda", "Linda Sánchez", "CA")], "author_handle string, author_name string, state string")
    people = spark.createDataFrame([], "bioguide string, first string, last string, nickname string, official_full string, "
                                       "states array<string>, last_term_end string")
    out = L.link_authors(authors, people, h).first()
    assert (out.bioguide, out.match_method) == ("A1", "handle")


def test_csv_parquet_lines_and_idempotent_write(spark):
    d = _tmp()
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", None)], "id int, k string, v double")
    S.write_csv(df, os.path.join(d, "csv"))
    back = S.read_csv(spark, os.path.join(d, "csv"), "id int, k string, v double")
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a", 0.5), (2, "b", None)]
    S.write_parquet(df, os.path.join(d, "pq"), partition_by=["k"])
    assert S.read_glob(spark, os.path.join(d, "pq")).count() == 2
    S.write_if_absent(df.limit(1), os.path.join(d, "pq"))          # exists: skipped
    assert S.read_glob(spark, os.path.join(d, "pq")).count() == 2
    with open(os.path.join(d, "lines.txt"), "w") as fh:
        fh.write("first text\n\n   \nsecond text\n")
    assert [r.text for r in S.read_lines(spark, os.path.join(d, "lines.txt")).collect()] == ["first text", "second text"]
    assert S.first_existing(spark, [os.path.join(d, "missing*"), os.path.join(d, "pq")]).endswith("pq")


def test_resumable_scoring_skips_done_files(spark):
    d = _tmp()
    src = os.path.join(d, "in")
    os.makedirs(src)
    import pandas as pd

    pd.DataFrame({"msg_id": [1, 2], "text": ["angry!!", "calm"]}).to_parquet(os.path.join(src, "a.parquet"))

    def scorer(df):
        return df.select("msg_id", F.length("text").alias("score"))

    target = os.path.join(d, "scores")
    out = score_new_files(spark, src, scorer, target)
    assert spark.read.parquet(out).count() == 2
    pd.DataFrame({"msg_id": [3], "text": ["new"]}).to_parquet(os.path.join(src, "b.parquet"))
    out2 = score_new_files(spark, src, scorer, target)       # same output: only the new file
    assert out2 == out and sorted(r.msg_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_linkage_from_records_attaches_birthday(spark):
    d = _tmp()
    recs = [{"id": {"bioguide": "A1"}, "bio": {"birthday": "1969-01-28", "gender": "F"},
             "name": {"first": "Linda", "last": "Sánchez", "nickname": None, "official_full": "Linda T. Sánchez"},
             "terms": [{"type": "rep", "start": "2003-01-03", "end": "2025-01-03", "state": "CA"}]},
            {"id": {"bioguide": "B2"}, "bio": {"birthday": "1949-04-15", "gender": "M"},
             "name": {"first": "Joseph", "last": "Barton", "nickname": "Joe"},
             "terms": [{"type": "rep", "start": "1985-01-03", "end": "2019-01-03", "state": "TX"}]}]
    with open(os.path.join(d, "legislators.json"), "w", encoding="utf8") as fh:
        json.dump(recs, fh)
    people = L.people_from_records(S.read_json_records(spark, [os.path.join(d, "legislators.json")],
                                                       schema=L.LEGISLATOR_SCHEMA))
    authors = spark.createDataFrame([("lsanchez", "Sánchez, Linda", "CA"), ("jb", "Joe Barton R-TX", "TX"),
                                     ("x", "Nobody Here", "NY")],
                                    "author_handle string, author_name string, state string")
    handles = spark.createDataFrame([], "handle string, bioguide string, snapshot string")
    out = {r.author_handle: r for r in L.link_authors(authors, people, handles).collect()}
    assert (out["lsanchez"].bioguide, out["lsanchez"].match_method) == ("A1", "name")
    assert str(out["lsanchez"].birthday) == "1969-01-28" and out["lsanchez"].gender == "F"
    assert (out["jb"].bioguide, out["jb"].match_method) == ("B2", "name")     # matched through the nickname
    assert out["x"].bioguide is None and out["x"].match_method is None


def test_score_missing_appends_only_new_ids(spark):
    from tonekit.streaming.incremental import score_missing

    d = _tmp()
    out = os.path.join(d, "scores")
    msgs = spark.createDataFrame([(1, "a"), (2, "bb")], "msg_id long, text string")

    def scorer(df):
        return df.select("msg_id", F.length("text").alias("score"))

    assert score_missing(spark, msgs, out, scorer) == 2
    more = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "ccc")], "msg_id long, text string")
    assert score_missing(spark, more, out, scorer) == 1
    assert score_missing(spark, more, out, scorer) == 0
    assert sorted((r.msg_id, r.score) for r in spark.read.parquet(out).collect()) == [(1, 1), (2, 2), (3, 3)]


def test_weekly_stream_counts_late_rows(spark):
    """Every week of the backlog is there, also the last ones and those of late files."""
    import datetime as dt

    import pandas as pd

    from tonekit.streaming.incremental import late_rows, run_weekly_stream, weekly_battery

    d = _tmp()
    src, out = os.path.join(d, "in"), os.path.join(d, "sums")
    os.makedirs(src)

    def put(name, days):
        pd.DataFrame({"ts": [dt.datetime(2024, 1, 1) + dt.timedelta(days=x) for x in days], "party": "D",
                      "anger": [0.25 + 0.5 * (x % 2) for x in days]}).to_parquet(os.path.join(src, name), coerce_timestamps="us")

    put("a.parquet", [0, 1, 40, 41])
    run_weekly_stream(spark, src, lambda x: x, out)
    put("b.parquet", [2, 3, 42])       # two rows are five weeks late
    run_weekly_stream(spark, src, lambda x: x, out)
    run_weekly_stream(spark, src, lambda x: x, out)   # nothing new: nothing counted twice
    sums = spark.read.parquet(out)
    got = {(str(r.wk), r.n, r.anger, r.share_angry) for r in weekly_battery(sums).collect()}
    assert got == {("2024-01-01", 4, 0.5, 0.5), ("2024-02-05", 2, 0.5, 0.5), ("2024-02-12", 1, 0.25, 0.0)}
    assert {r.batch: (r.rows, r.late) for r in late_rows(sums).collect()} == {0: (4, 0), 1: (3, 2)}


def test_json_document_text(spark):
    from tonekit.operators import export as X

    df = spark.createDataFrame([(2, float("nan")), (1, 0.123456)], "year int, v double")
    doc = X.json_document(X.rounded_for_export(df)).first().json
    assert json.loads(doc) == {"year": [1, 2], "v": [0.1235, None]}


def test_missing_shared_folder_is_an_error():
    import pytest

    from tonekit.session import checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://cluster:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
