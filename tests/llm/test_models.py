"""Quality, licences, language and decontamination; the pipeline's stages."""
import numpy as np
import pytest
from llm_rows import frame, key, rough_rows, rows_of, words
from pyspark.sql import functions as F

from tonekit.llm import decontam, language, licences, quality

ROWS = rough_rows()
ROOT = "/root/testdata/sf0.01"


def read(spark, name, root=ROOT):
    return spark.read.parquet(f"{root}/{name}.parquet")


# -- quality ---------------------------------------------------------------------------------
def test_posterior_by_hand(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 7, f"h{i % 5}" if i % 3 else "big", f"p{i % 7}", [None, 0.0, 1.0][i % 3 if i % 2 else 0],
             float(rng.normal(1, 2))) for i in range(300)]
    df = spark.createDataFrame(rows, "did long, th long, host string, path string, label double, evidence double")
    got = {r.did: r for r in quality.posterior(df).collect()}

    labels = [r[4] for r in rows if r[4] is not None]
    start = min(1 - 1e-3, max(1e-3, float(np.mean(labels))))
    y = np.array([r[4] if r[4] is not None else 1 / (1 + np.exp(-r[5] - np.log(start / (1 - start)))) for r in rows])
    sums = {}
    for r, v in zip(rows, y):
        for g in ((r[2],), (r[2], r[3])):
            n, k = sums.get(g, (0, 0.0))
            sums[g] = n + 1, k + v
    rate = y.mean()

    def moments(groups):
        n, k, p = (np.array(x, float) for x in zip(*groups))
        p = np.clip(p, 1e-6, 1 - 1e-6)
        total = n.sum()
        between = (((k / n - p) ** 2 * n).sum() - (p * (1 - p)).sum() * (len(n) - 1) / len(n)) / (total - (n ** 2).sum() / total)
        return min(1e4, max(1, (p * (1 - p) * n).sum() / total / between - 1)) if between > 0 else 1e4

    m = moments([(n, k, rate) for g, (n, k) in sums.items() if len(g) == 1])
    host = {g[0]: (k + m * rate) / (n + m) for g, (n, k) in sums.items() if len(g) == 1}
    mp = moments([(n, k, host[g[0]]) for g, (n, k) in sums.items() if len(g) == 2])
    for r, v in zip(rows, y):
        hn, hk = sums[(r[2],)]
        n, k = sums[(r[2], r[3])]
        own_host = (hk - v + m * rate) / (hn - 1 + m)
        own = np.clip((k - v + mp * own_host) / (n - 1 + mp), 1e-6, 1 - 1e-6)
        g = got[r[0]]
        assert g.host_rate == pytest.approx(host[r[2]]) and g.path_rate == pytest.approx((k + mp * host[r[2]]) / (n + mp))
        assert g.p_quality == pytest.approx(1 / (1 + np.exp(-r[5] - np.log(own / (1 - own)))))


def test_sparse_paths_shrink(spark):
    rows = [(i, 0, "good", "a", 1.0, 0.0) for i in range(200)] + [(1000 + i, 0, "bad", "a", 0.0, 0.0) for i in range(200)]
    rows += [(2000, 0, "good", "new", 0.0, 0.0), (2001, 0, "fresh", "x", None, 0.0)]
    df = spark.createDataFrame(rows, "did long, th long, host string, path string, label double, evidence double")
    got = {r.did: r for r in quality.posterior(df).collect()}
    assert got[0].path_rate > 0.9 and got[1000].path_rate < 0.1
    assert got[2000].path_rate > 0.4  # one bad document hardly moves a path of a good host
    assert 0.3 < got[2001].host_rate < 0.7


def test_quality_finds_junk_in_unseen_documents(spark):
    labels = read(spark, "labels")
    docs = read(spark, "documents")
    got = quality.assess(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    assert len(got) > 100
    assert sum(r.keep == (r.quality == 1) for r in got) / len(got) > 0.97
    assert all(r.keep for r in got if r.quality == 1)


def test_quality_of_rough_rows(spark, rough, nothing):
    labels = spark.createDataFrame([(0, 1), (17, 0), (19, 0), (0, None), (None, 1), (17, 0)], "doc_id long, quality int")
    got = quality.assess(rough, labels)
    assert got.count() == len(ROWS) and got.filter("p_quality is null or keep is null").count() == 0
    assert quality.assess(nothing, labels).count() == 0
    none = quality.assess(rough, labels.filter("false"))
    assert none.filter("evidence <> 0").count() == 0 and none.count() == len(ROWS)


# -- licences --------------------------------------------------------------------------------
def test_licence_families(spark):
    docs = read(spark, "documents").cache()
    got = licences.scan(docs).join(docs.select("doc_id", "text"), "doc_id")
    line = F.regexp_extract("text", r"(Apache License, Version 2\.0|GNU General Public License, version 3|MIT License"
                            r"|CC BY-NC 4\.0)", 1)
    family = {"Apache License, Version 2.0": "apache", "GNU General Public License, version 3": "gpl",
              "MIT License": "mit", "CC BY-NC 4.0": "cc-by-nc", "": None}
    rows = got.select(line.alias("line"), "licence", "text").collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.line:
            assert r.licence == family[r.line]
        else:
            assert r.licence in ("none", "unknown")
            assert r.licence == "none" or any(w in r.text.lower() for w in ("rights", "licen", "copyright", "permission"))


def test_licence_rough_rows(spark, rough, nothing):
    assert {r.licence for r in licences.scan(rough).collect()} == {"none"}
    assert licences.scan(nothing).count() == 0
    docs = frame(spark, [(1, words(1, 50) + "\nReleased under the MIT license\n" + words(2, 50)), (2, None),
                         (3, "SPDX-License-Identifier: Apache-2.0"), (4, words(3, 300)),
                         (5, "This text may be used by holders of the Foo Bar License only"),
                         (5, "This text may be used by holders of the Foo Bar License only")])
    got = licences.scan(docs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    rows = [(r.doc_id, r.licence) for r in got.orderBy("doc_id").collect()]
    assert rows == [(1, "mit"), (2, "none"), (3, "apache"), (4, "none"), (5, "unknown"), (5, "unknown")]


def test_licence_wrapped_notices(spark):
    """Each family's notices, wrapped and commented, alone and before other lines without a blank one."""
    import textwrap

    marks = {"": "{}", "#": "# {}", "//": "// {}", "*": " * {}", "dnl": "dnl {}"}
    rows, want = [], {}
    for family, notices in licences.TEMPLATES.items():
        for t in notices:
            for k, mark in enumerate(marks.values()):
                wrapped = [mark.format(x) for x in textwrap.wrap(t, 24 if k % 2 else 40)]
                after = [words(len(rows) + i, 8) for i in range(12 * (k % 2))]
                text = "\n".join([words(7, 9), mark.format(""), "/*", *wrapped, *after, " */", "", words(8, 9)])
                rows.append((len(rows), text))
                want[len(rows) - 1] = family
    others = read(spark, "documents").select(F.expr("doc_id + 100000").alias("doc_id"), "text")
    docs = frame(spark, rows).select("doc_id", "text").unionByName(others)
    got = {r.doc_id: r for r in licences.scan(docs).filter("doc_id < 100000").collect()}
    wrong = [(i, f, got[i].licence, rows[i][1]) for i, f in want.items() if got[i].licence != f]
    assert not wrong, wrong
    assert all(f in got[i].families for i, f in want.items())


# -- language --------------------------------------------------------------------------------
def test_language_held_out(spark):
    docs = read(spark, "documents")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_mixture(spark):
    docs = read(spark, "documents").select("doc_id", "text", "lang")
    long = {r.lang: r.text for r in docs.filter("length(text) > 4000").orderBy(F.desc("doc_id")).collect()}
    mixed = spark.createDataFrame([(-1, long["en"][:3000] + "\n" + long["de"][:1000], None),
                                   (-2, long["fr"][:1500], None), (-3, "", None), (-4, "12 34 !?", None)], docs.schema)
    got = {r.doc_id: r for r in language.identify(docs.unionByName(mixed)).filter("doc_id < 0").collect()}
    assert got[-1].lang_pred == "en" and sorted(got[-1].langs) == ["de", "en"] and 0.6 < got[-1].score < 0.9
    assert got[-2].langs == ["fr"] and got[-2].score == pytest.approx(1)
    assert got[-3].lang_pred == got[-4].lang_pred == "und" and got[-3].score == 0


def test_mixture_by_hand():
    rng = np.random.default_rng(1)
    like = rng.normal(0, 2, (40, 3))
    like[:30, 0] += 6
    like[30:, 2] += 6
    score, share = language._mixture(like, np.array([0, 30]), np.ones((2, 3), bool))
    for a, b, s, p in ((0, 30, score[0], share[0]), (30, 40, score[1], share[1])):
        assert p.sum() == pytest.approx(1)
        assert s == pytest.approx(np.log(np.exp(like[a:b]) @ p).sum())
        for _ in range(200):  # no other proportions explain the stretches better
            q = rng.dirichlet([1, 1, 1])
            assert np.log(np.exp(like[a:b]) @ q).sum() <= s + 1e-3


def test_language_rough_rows(rough, nothing):
    got = language.identify(rough).collect()
    assert len(got) == len(ROWS) and {r.lang_pred for r in got} <= {"en", "und"}
    assert language.identify(nothing).count() == 0


# -- decontamination -------------------------------------------------------------------------
def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit("clash"))


ITEMS = [(1, " ".join(words(3, 60).split()[5:30])), (2, None), (3, ""), (4, "ONE"), (5, words(50, 12)), (5, words(50, 12)),
         (6, words(4, 30000)[5100:5400]), (None, " ".join(words(1, 120).split()[:11])), (7, "123 456"), (10, "one, one!")]
DIGEST = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("block", [8 << 20, 200])
def test_decontamination(spark, rough, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontam, "SHARD_BYTES", 6000)
    got = rows_of(decontam.contamination(rough, bench(spark, ITEMS)), *DIGEST)
    assert got == sorted(decontam.brute_force(ROWS, ITEMS), key=key)


def test_proximity(spark):
    item = words(70, 10)
    w = item.split()
    docs = frame(spark, [(1, words(71, 20) + " " + item), (2, " ".join(w[:5] + ["extra"] + w[5:])), (3, " ".join(w[::-1])),
                         (4, " ".join(w[:5] + words(72, 9).split() + w[5:]))])
    exact = {r.doc_id: r.contaminated for r in decontam.contamination(docs, bench(spark, [(1, item)])).collect()}
    near = {r.doc_id: r.contaminated for r in decontam.contamination(docs, bench(spark, [(1, item)]), slop=2).collect()}
    assert exact == {1: True, 2: False, 3: False, 4: False}
    assert near == {1: True, 2: True, 3: False, 4: False}


def test_decontamination_empty(spark, rough, nothing):
    assert decontam.contamination(nothing, bench(spark, ITEMS)).count() == 0
    none = decontam.contamination(rough, bench(spark, [])).collect()
    assert len(none) == len(ROWS) and not any(r.contaminated for r in none)


# -- pipeline --------------------------------------------------------------------------------
def test_stages_one_by_one(spark, tmp_path):
    import corpus_pipeline as P

    from tonekit.llm import bpe, exact_dedup, simhash

    docs = read(spark, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in P.STAGES:
        out = stage(spark, docs, ROOT)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "quality_classifier":
            want = {r.doc_id for r in quality.assess(docs, read(spark, "labels")).filter("keep").collect()}
        elif name == "exact_dedup":
            want = {r.doc_id for r in exact_dedup.exact_dedup(docs).filter("kept").collect()}
        elif name == "simhash_near_dedup":
            want = {r.component_id for r in simhash.near_duplicates(docs).collect()}
        elif name == "benchmark_decontamination":
            want = {r[0] for r in decontam.brute_force(
                [(r.doc_id, r.text) for r in docs.collect()],
                [(r.item_id, r.text) for r in read(spark, "benchmark").collect()]) if not r[5]}
        else:
            want = ids
            assert out.columns == bpe.encode(docs).columns
        if name != "byte_bpe":
            assert out.columns == columns
            out.write.parquet(str(tmp_path / name))
            docs = out = spark.read.parquet(str(tmp_path / name))
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(want)
        assert want < ids or name == "byte_bpe"
    assert n > len(want) > n / 2


def test_stages_on_rough_rows(spark, rough, nothing):
    import corpus_pipeline as P

    for docs in (rough, nothing):
        for name, stage in P.STAGES:
            out = stage(spark, docs, ROOT)
            assert out.count() <= len(ROWS)
            if name != "byte_bpe":
                assert out.columns == docs.columns


def test_stages_keep_one_row_of_what_repeats(spark):
    import corpus_pipeline as P

    text = "one two three four five six seven eight"
    rows = [(1, text), (1, text), (1, text.replace(" ", "  ")), (2, text), (None, "null " + text), (None, "null " + text),
            (None, "null  " + text), (3, "other words that stand here alone"), (3, "quite another text of the same id"), (None, None), (None, "")]
    docs = frame(spark, rows, clash=False)
    got = rows_of(P.exact_dedup_stage(spark, docs, ROOT), "doc_id", "text")
    ones = [t for i, t in got if i == 1]
    nulls = [t for i, t in got if i is None and t]
    assert len(ones) == 1 and len(nulls) == 1 and " ".join(nulls[0].split()) == "null " + text
    assert [t for i, t in got if i == 3] == sorted(t for i, t in rows if i == 3) and not [t for i, t in got if i == 2]
    assert len([t for i, t in got if not t]) == 1 and P.exact_dedup_stage(spark, docs, ROOT).columns == docs.columns
    near = frame(spark, [(5, text), (5, text + "!"), (6, text), (7, "far from all the rest of them")], clash=False)
    from tonekit.llm import simhash

    assert len({r.component_id for r in simhash.near_duplicates(near).collect()}) <= 3
    kept = rows_of(P.near_dedup_stage(spark, near, ROOT), "doc_id", "text")
    assert [i for i, _ in kept].count(6) == 0 and (7, "far from all the rest of them") in kept
