"""What lets queries grow with their tables: sizes of files, passes over rows, work a row."""
import glob

import pytest
import yaml
from pyspark.sql import functions as F

from tonekit.functions import text as TX
from tonekit.operators import link as L
from tonekit.operators import scoring
from tonekit.operators import trained as T
from tonekit.plans import load_all, stream_queries
from tonekit.plans import source_queries as SQ
from tonekit.plans.registry import QUERIES
from tonekit.session import checkpoint_dir

load_all()


def test_handle_history_writes_files_of_bounded_size(spark, tmp_path):
    n = 2 * SQ.YAML_FILE + 7
    spark.range(1, n + 1).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    before = set(glob.glob(f"{checkpoint_dir(spark)}/snapshots-*"))
    got = QUERIES["handle_history"](spark, str(tmp_path))
    (made,) = set(glob.glob(f"{checkpoint_dir(spark)}/snapshots-*")) - before
    for name in SQ.SNAPSHOTS[:-1]:
        sizes = [sum(line.startswith("- ") for line in open(f)) for f in glob.glob(f"{made}/{name}/*.txt")]
        assert sum(sizes) == n and max(sizes) <= SQ.YAML_FILE
    assert got.select("bioguide").distinct().count() == n


def test_a_snapshot_is_parsed_once(spark, tmp_path):
    for at in range(3):
        (tmp_path / f"s{at}.yaml").write_text("- id: {bioguide: A1}\n  social: {twitter: RepA}\n")
    found = L.snapshot_handles(spark, [str(tmp_path / f"s{at}.yaml") for at in range(3)])
    spans = L.handle_intervals(found)
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan
    assert [tuple(r) for r in spans.collect()] == [("repa", "A1", 0, None)]


@pytest.mark.parametrize("text", [
    "".join(f"- id: {{bioguide: A{i}}}\n  social:\n    twitter: T{i}\n" for i in range(9)),
    "- &a {x: 1}\n- *a\n- b\n- *a\n", '- "one\n\n- two"\n- three\n- four\n', "k:\n- a\n- b\n- c\n",
    "# list\n- a\n- b\n- c\n", "- a\n# not one\n- b\n- - c\n  - d\n- |\n  - e\n", "", "- 1\n- 2012-01-01\n- ~\n"])
def test_records_cut_at_any_place_are_those_of_the_whole_list(text):
    for chunk in (1, 2, 3):
        assert L.yaml_records(text, chunk) == (yaml.safe_load(text) or [])


def test_buckets_made_in_tasks_are_those_of_the_columns(spark):
    texts = ["The cat sat on the mat, the cat.", "", None, "@me https://x.y/z İstanbul ÀÉ 𝔘nicode " + "w" * 70, "a", "? !", "b a " * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    found = F.regexp_extract_all(F.lower(TX.model_input(F.coalesce(F.col("text"), F.lit("")))), F.lit(f"{T.WORD}|{T.OTHER}"), F.lit(0))
    old = T.hashed(T.features(F.slice(found, 1, 128)), 15)
    want = {r.i: sorted(r.f) for r in df.select("i", old.alias("f")).collect()}
    made = T.with_buckets(df, "text", 15, 128)
    assert {r.i: sorted(r._f) for r in made.collect()} == want
    assert "md5" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_capitals_are_not_looked_up_one_by_one(spark):
    df = spark.createDataFrame([("aBCd É É!",), (None,), ("",)], "text string")
    f = scoring._features(F.col("text"))["caps"]
    assert [r[0] for r in df.select(f).collect()] == [2 / 9, None, 0.0]
    assert "translate" not in df.select(f)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_rescored_files_take_as_many_steps_however_many_files_the_documents_are(spark, tmp_path, monkeypatch):
    spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("good day "), F.col("id").cast("string")).alias("text")
                            ).repartition(24).write.option("maxRecordsPerFile", 5).parquet(str(tmp_path / "documents.parquet"))
    steps, update = [], stream_queries.M.update
    monkeypatch.setattr(stream_queries.M, "update", lambda *a, **k: steps.append(update(*a, **k)) or steps[-1])
    monkeypatch.setattr(stream_queries, "PART_FILES", 2)
    assert QUERIES["rescored_files"](spark, str(tmp_path)).count() == 200
    assert sum(s["steps"] for s in steps) <= 6


def test_spike_terms_joins_no_tokens_to_posts(spark):
    root = "/root/testdata/sf0.001"
    plan = QUERIES["spike_terms"](spark, root)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_totalprice" not in plan and "l_discount" not in plan  # the posts were counted and written
