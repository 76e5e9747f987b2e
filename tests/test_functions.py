"""Literal-row checks of the column functions (calendar, text, flags)."""
import datetime as dt

from pyspark.sql import functions as F

from tonekit.functions import calendar as cal
from tonekit.functions import text as T
from tonekit.operators import enrich as EN
from tonekit.operators.registers import portable


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_election_day_and_rollover(spark):
    rows = [(dt.datetime(2024, 11, 5, 12),), (dt.datetime(2024, 11, 6, 1),), (dt.datetime(2023, 3, 1),),
            (dt.datetime(2026, 1, 1),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz").select(
        cal.next_election("ts").alias("e"), cal.days_between("ts", cal.next_election("ts")).alias("d"))
    got = [(r.e, r.d) for r in df.collect()]
    assert got[0] == (dt.date(2024, 11, 5), 0)          # election day itself
    assert got[1] == (dt.date(2026, 11, 3), 727)        # the day after -> two years later
    assert got[2][0] == dt.date(2024, 11, 5)            # odd year -> next even year
    assert got[3][0] == dt.date(2026, 11, 3)


def test_eastern_calendar_new_year_and_dst(spark):
    rows = [(dt.datetime(2020, 1, 1, 3, 30),), (dt.datetime(2021, 3, 14, 7, 30),), (dt.datetime(2021, 11, 7, 7, 30),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    out = EN.add_calendar(df).select("year", "hour_et", "month", "season", "dow_et").collect()
    assert (out[0].year, out[0].hour_et, out[0].month, out[0].season) == (2020, 22, 12, "Winter")  # UTC year != ET year
    assert out[1].hour_et == 3       # after the spring switch (UTC-4)
    assert out[2].hour_et == 2       # after the autumn switch (UTC-5; 3 under UTC-4)


def test_local_hour_zones_and_default(spark):
    zones = EN.zone_table(spark)
    rows = [(1, "HI", dt.datetime(2024, 1, 1, 12)), (2, "GU", dt.datetime(2024, 1, 1, 12)),
            (3, None, dt.datetime(2024, 1, 1, 12)), (4, "ZZ", dt.datetime(2024, 1, 1, 12))]
    df = spark.createDataFrame(rows, "id int, state string, ts timestamp_ntz")
    got = {r.id: r.hour_local for r in EN.add_zone_hour(df, zones).collect()}
    assert got == {1: 2, 2: 22, 3: 7, 4: 7}


def test_buckets(spark):
    df = spark.createDataFrame([(h,) for h in [0, 4, 5, 8, 9, 17, 18, 20, 21, 23]], "h int")
    bands = [r[0] for r in df.select(cal.hour_band("h")).collect()]
    assert bands == ["00-04 night", "00-04 night", "05-08 morning", "05-08 morning", "09-17 work", "09-17 work",
                     "18-20 evening", "18-20 evening", "21-23 late", "21-23 late"]
    eras = spark.createDataFrame([(dt.datetime(2017, 1, 19, 23, 59),), (dt.datetime(2017, 1, 20),),
                                  (dt.datetime(2025, 1, 20),)], "ts timestamp_ntz").select(cal.era("ts")).collect()
    assert [r[0] for r in eras] == ["Obama", "Trump", "Trump II"]
    gens = spark.createDataFrame([(dt.date(1945, 12, 31),), (dt.date(1946, 1, 1),), (dt.date(1997, 1, 1),)],
                                 "b date").select(cal.generation("b")).collect()
    assert [r[0] for r in gens] == ["Silent", "Boomer", "Gen Z"]
    bins = spark.createDataFrame([(24.9,), (25.0,), (95.0,), (95.1,)], "a double").select(cal.fixed_bin("a")).collect()
    assert [r[0] for r in bins] == [20, 25, 95, 95]


def test_chamber_and_state(spark):
    rows = [("Senate", "GUAM"), ("senator", "MARIANA"), ("House", "NY"), ("representative", None), ("other", "ZZ")]
    df = spark.createDataFrame(rows, "chamber string, state string").select(
        EN.normalise_chamber("chamber").alias("c"), EN.normalise_state("state").alias("s"))
    assert [tuple(r) for r in df.collect()] == [("Senate", "GU"), ("Senate", "MP"), ("House", "NY"),
                                                ("House", None), (None, "ZZ")]


def test_text_helpers(spark):
    assert one(spark, T.model_input(F.col("x")), "@josé hi https://t.co/x ") == "@user hi http"
    assert one(spark, T.clean_display_name(F.col("x")), "Joe Barton R-TX") == "Joe Barton"
    long = "word " * 60
    tidy = one(spark, T.tidy_text(F.col("x")), long + "https://t.co/abc &amp; end")
    assert tidy.endswith("…") and len(tidy) <= 218
    assert one(spark, T.tidy_text(F.col("x")), "a &amp; b\n\nc https://x.y") == "a & b c"
    toks = sorted(one(spark, T.tokens(F.col("x")), "The GOP's #Budget budget @user RT https://x.y fight-back"))
    assert toks == ["#budget", "budget", "fight-back", "gop's"]


def test_fold_and_portable_regex(spark):
    assert one(spark, T.fold_ascii(F.col("x")), "Sánchez-O'Neil  ") == "sanchezoneil"
    pat = portable(r"(\bgop\b|\bunite[ds]?\b)")
    df = spark.createDataFrame([("égop",), ("the gop.",), ("united we",), ("reunited",)], "x string")
    # as in RE2 (the reference engine), an accented letter is not a word character
    assert [r[0] for r in df.select(F.col("x").rlike(pat)).collect()] == [True, True, True, False]
