"""Resumable scoring by manifest, committed steps."""
import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tonekit.sources import files as S
from tonekit.streaming import manifest as M


def put(folder, name, ids, text="a"):
    os.makedirs(folder, exist_ok=True)
    table = pa.table({"msg_id": pa.array(ids, pa.int64()), "text": pa.array([text * (i + 1) for i in ids], pa.string())})
    pq.write_table(table, os.path.join(folder, name))


def scorer(df):
    return df.select("msg_id", F.length("text").alias("score"), M.FILE)


def scores(spark, out):
    return sorted((r.msg_id, r.score) for r in M.current(spark, out).collect())


@pytest.fixture
def place():
    d = tempfile.mkdtemp(prefix="tonekit-manifest-")
    return os.path.join(d, "in"), os.path.join(d, "out")


def test_only_changes_are_scored_and_replaced_rows_go(spark, place):
    src, out = place
    put(src, "a b%.parquet", [1, 2])  # a name that a URL would escape
    put(src, "c.parquet", [3])
    assert M.update(spark, src, scorer, out) == {"steps": 1, "scored": 2, "gone": 0, "rows": 3}
    assert scores(spark, out) == [(1, 2), (2, 3), (3, 4)]
    assert M.update(spark, src, scorer, out) == {"steps": 0, "scored": 0, "gone": 0, "rows": 0}
    put(src, "c.parquet", [3, 4, 5], text="bb")  # replaced under the same name
    put(os.path.join(src, "sub"), "d.parquet", [6])  # a new file in a folder
    assert M.update(spark, src, scorer, out) == {"steps": 1, "scored": 2, "gone": 0, "rows": 4}
    assert scores(spark, out) == [(1, 2), (2, 3), (3, 8), (4, 10), (5, 12), (6, 7)]
    os.remove(os.path.join(src, "a b%.parquet"))
    assert M.update(spark, src, scorer, out) == {"steps": 1, "scored": 0, "gone": 1, "rows": 0}
    assert scores(spark, out) == [(3, 8), (4, 10), (5, 12), (6, 7)]
    put(src, "a b%.parquet", [1])  # back again
    M.update(spark, src, scorer, out)
    assert scores(spark, out)[0] == (1, 2)


def test_a_table_that_grows_at_its_path_is_scored_again(spark, place):
    src, out = place
    put(src, "documents.parquet", list(range(200)))
    M.update(spark, f"{src}/documents.parquet", scorer, out)
    put(src, "documents.parquet", list(range(1000)))
    M.update(spark, f"{src}/documents.parquet", scorer, out)
    assert scores(spark, out) == [(i, i + 1) for i in range(1000)]


def test_a_killed_run_goes_on_where_it_stopped(spark, place):
    src, out = place
    for i in range(5):
        put(src, f"f{i}.parquet", [10 * i, 10 * i + 1])
    calls = []

    def dies(df):
        calls.append(df.select(M.FILE).distinct().count())
        if len(calls) == 2:
            raise KeyboardInterrupt
        return scorer(df)

    with pytest.raises(KeyboardInterrupt):
        M.update(spark, src, dies, out, max_files=2)
    # what a step that died after writing rows but before its manifest leaves behind
    scorer(spark.read.parquet(src).withColumn(M.FILE, F.lit("x"))).write.parquet(f"{out}/scores/gen=2")
    assert len(scores(spark, out)) == 4
    assert M.update(spark, src, scorer, out, max_files=2) == {"steps": 2, "scored": 3, "gone": 0, "rows": 6}
    assert [i for i, _ in scores(spark, out)] == [0, 1, 10, 11, 20, 21, 30, 31, 40, 41]


def test_steps_can_be_bounded(spark, place):
    src, out = place
    for i in range(3):
        put(src, f"f{i}.parquet", [i])
    assert M.update(spark, src, scorer, out, max_files=1, max_steps=2)["steps"] == 2
    assert len(scores(spark, out)) == 2
    assert M.update(spark, src, scorer, out, max_files=1)["steps"] == 1


def test_files_without_rows_and_scorers_that_lose_the_file(spark, place):
    src, out = place
    put(src, "none.parquet", [])
    put(src, "one.parquet", [1])
    assert M.update(spark, src, scorer, out)["rows"] == 1
    assert M.update(spark, src, scorer, out)["steps"] == 0
    put(src, "two.parquet", [2])
    with pytest.raises(ValueError, match="_file"):
        M.update(spark, src, lambda df: df.select("msg_id"), out)


def test_merge_makes_one_sorted_table(spark, place):
    src, out = place
    for i in range(4):
        put(src, f"f{i}.parquet", [i, i + 10, i + 20])
    M.update(spark, src, scorer, out, max_files=1)
    final = out + "-final"
    got = M.merge(spark, out, final, key="msg_id", files=2)
    assert got.columns == ["msg_id", "score"] and got.count() == 12 and S.committed(spark, final)
    assert len([f for f in os.listdir(final) if f.endswith(".parquet")]) == 2
    put(src, "f0.parquet", [100])
    M.update(spark, src, scorer, out)
    assert sorted(r.msg_id for r in M.merge(spark, out, final, key="msg_id").collect()) == [1, 2, 3, 11, 12, 13, 21, 22, 23, 100]


def test_no_task_holds_memory_for_every_partition(place):
    """In a process of its own, for its event log and small pages: a table that a task holds is 1 MB."""
    import json
    import subprocess
    import sys

    src, out = place
    for i in range(3):
        put(src, f"f{i}.parquet", [10 * i, 10 * i + 1])
    events = tempfile.mkdtemp(prefix="tonekit-events-")
    code = f"""
from pyspark.sql import SparkSession, functions as F
from tonekit.streaming import manifest as M
conf = {{"spark.ui.enabled": "false", "spark.default.parallelism": "32", "spark.sql.shuffle.partitions": "32",
        "spark.buffer.pageSize": "1m", "spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://{events}",
        "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"}}
s = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
score = lambda df: df.select("msg_id", F.length("text").alias("score"), M.FILE)
assert M.update(s, {src!r}, score, {out!r}, max_files=2) == {{"steps": 2, "scored": 3, "gone": 0, "rows": 6}}
assert M.merge(s, {out!r}, {out!r} + "-final", key="msg_id").count() == 6
s.stop()
"""
    env = dict(os.environ, PYTHONPATH=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=env)
    assert got.returncode == 0, got.stderr[-2000:]
    peaks = []
    for name in os.listdir(events):
        if not name.startswith("."):
            with open(os.path.join(events, name)) as f:
                ended = [e for e in map(json.loads, f) if e["Event"] == "SparkListenerTaskEnd"]
            peaks += [e["Task Metrics"]["Peak Execution Memory"] for e in ended]
    assert peaks and max(peaks) < 8 << 20


# -- committed steps -----------------------------------------------------------------------------
def test_a_folder_left_by_a_crash_is_written_again(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tonekit-step-"), "table")
    os.makedirs(os.path.join(path, "_temporary", "0"))  # all that a killed job leaves
    df = spark.range(5)
    assert not S.committed(spark, path)
    assert S.write_committed(df, path) and S.committed(spark, path)
    assert spark.read.parquet(path).count() == 5
    assert not S.write_committed(spark.range(9), path)  # finished: skipped
    assert spark.read.parquet(path).count() == 5
    assert S.write_committed(spark.range(9), path, rebuild=True)
    assert spark.read.parquet(path).count() == 9


def test_a_partly_moved_folder_is_written_again(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tonekit-step-"), "table")
    S.write_committed(spark.range(5), path)
    os.remove(os.path.join(path, S.COMMITTED))
    assert S.write_committed(spark.range(6), path, partition_by=[])
    assert spark.read.parquet(path).count() == 6


def test_a_failed_write_leaves_the_old_table(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tonekit-step-"), "table")
    S.write_committed(spark.range(5), path)
    bad = spark.range(3).select(F.assert_true(F.col("id") < 2).alias("x"))
    with pytest.raises(Exception, match="(?i)assert|USER_RAISED"):
        S.write_committed(bad, path, rebuild=True)
    assert spark.read.parquet(path).count() == 5 and S.committed(spark, path)


def test_a_local_session_that_names_no_folder_gets_one():
    """In a process of its own, as the setting is fixed when a session starts."""
    import subprocess
    import sys

    code = ("from pyspark.sql import SparkSession; from tonekit.session import checkpoint_dir, materialize; "
            "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate(); "
            "d = checkpoint_dir(s); assert d and d == checkpoint_dir(s); assert materialize(s.range(3)).count() == 3; print('held', d)")
    env = dict(os.environ, PYTHONPATH=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, env=env)
    assert "held" in got.stdout, got.stderr[-2000:]
