"""Plan checks: no query may contain a Cartesian product or a nested-loop join, and
scans must prune columns (a scan of every column of a wide table is a bug)."""
import contextlib
import io

import pytest

import __spark_entry__ as E
from tonekit.plans import QUERIES, load_all

SF = "/root/testdata/sf0.001"
load_all()
SKIP = {"resumable_scores", "rescored_files", "weekly_stream", "weekly_windows"}   # these run a stream to completion when built


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_no_cartesian_or_nested_loop(spark, name):
    text = plan_text(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in text, name
    assert "BroadcastNestedLoopJoin" not in text, name


def test_battery_pushes_filter_and_prunes(spark):
    from pyspark.sql import functions as F

    from tonekit.operators.battery import mean_battery
    from tonekit.plans.views import posts

    q = mean_battery(posts(spark, SF), ["year"], min_n=1, where=F.col("anger") > 0.5)
    text = plan_text(q)
    assert "PushedFilters: [IsNotNull(o_totalprice)" in text       # the score filter reaches the orders scan
    scans = [l for l in text.splitlines() if l.startswith("ReadSchema: struct<o_orderkey")]
    assert scans and all("o_orderpriority" not in s and "o_orderstatus" not in s for s in scans)
    li = [l for l in text.splitlines() if l.startswith("ReadSchema: struct<l_orderkey")]
    assert li and all("l_shipdate" not in s and "l_returnflag" not in s for s in li)


def test_bucketed_id_join_needs_no_shuffle(spark):
    """D1 at scale: messages and scores stored bucketed by the id join without an Exchange."""
    import uuid

    from pyspark.sql import functions as F

    from tonekit.sources.files import write_bucketed

    tag = uuid.uuid4().hex[:8]
    msgs = spark.range(2000).select(F.col("id").alias("msg_id"), (F.col("id") % 7).alias("author"))
    scores = spark.range(2000).select(F.col("id").alias("msg_id"), (F.col("id") / 2000.0).alias("anger"))
    write_bucketed(msgs, f"m_{tag}", "msg_id", 8)
    write_bucketed(scores, f"s_{tag}", "msg_id", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table(f"m_{tag}").join(spark.table(f"s_{tag}"), "msg_id")
        text = plan_text(joined)
        assert "SortMergeJoin" in text and "Exchange" not in text
        assert joined.count() == 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


PYTHON_OK = {"model_scores", "trained_scores", "trained_report",   # models
             "handle_history"}   # YAML


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP - PYTHON_OK))
def test_stays_in_the_jvm(spark, name):
    text = plan_text(E.queries()[name](spark, SF))
    for node in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in text, (name, node)


#: Queries whose per-group winners (newest attributes, highest score) were sort aggregates over all messages.
WINNERS = ["network_members", "volume_rate", "author_leaderboard", "rate_lookup", "statement_card", "exemplars",
           "driver_attribution", "author_cells"]


@pytest.mark.parametrize("name", WINNERS)
def test_winners_sort_no_messages(spark, name, monkeypatch):
    """The first aggregate over the messages is a HashAggregate: no SortAggregate has one below it but
    those over the cells."""
    import re

    monkeypatch.setattr("tonekit.plans.views.stored", lambda df, name="": df)  # the plan down to the scans
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = QUERIES[name](spark, SF)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        tree = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = tree.splitlines()
    depth = [len(re.match(r"[ :+\-*(\d)]*", line)[0]) for line in lines]
    for i, line in enumerate(lines):
        if "SortAggregate" in line:
            below = []
            for other, d in zip(lines[i + 1:], depth[i + 1:]):
                if d <= depth[i]:
                    break
                below.append(other)
            assert any("HashAggregate" in x or "Scan ExistingRDD" in x for x in below), (name, line[:200])


def test_dedup_groups_repeated_ids_only(spark):
    """The rows of ids that occur once are not shuffled if the repeated ids fit a broadcast."""
    from pyspark.sql import functions as F

    from tonekit.operators.enrich import dedup_first

    df = spark.range(1000).select((F.col("id") % 990).alias("id"), F.col("id").cast("string").alias("source"))
    out = dedup_first(df, "id", ["source"])
    assert out.count() == 990
    text = plan_text(out)
    assert "LeftAnti" in text and "LeftSemi" in text


def test_colocated_posts_join_without_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        from tonekit.plans.views import posts, store_posts

        df = posts(spark, SF, stored=store_posts(spark, SF))
        tree = df._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    at = next(i for i, line in enumerate(tree) if "SortMergeJoin [o_orderkey" in line)
    depth = tree[at].index("SortMergeJoin")
    under = [line for line in tree[at + 1:] if len(line) - len(line.lstrip(" :+-*()0123456789")) > depth]
    scans = [line for line in under[:8] if "FileScan" in line]
    assert len(scans) == 2 and all("Bucketed: true" in s for s in scans)
    assert not any("Exchange" in line for line in under[:under.index(scans[1])])


@pytest.mark.parametrize("page", [0, 3])
def test_a_page_opens_its_ranges_only(spark, page):
    from pyspark.sql import functions as F

    from tonekit.operators.paging import row_index

    index = row_index(spark.range(4000).select((F.col("id") * 7919 % 4000).alias("k")), ["k"], ranges=8)
    df = index.page(page, 100, "row")
    text = plan_text(df)
    assert "PartitionFilters: [isnotnull(_range" in text and "PushedFilters: [IsNotNull(_place)" in text
    assert sorted(r.k for r in df.collect()) == list(range(100 * page, 100 * page + 100))
