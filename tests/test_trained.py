"""Trained scorer: tokens, features, fit, truncation (M1, M2)."""
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonekit import constants as K
from tonekit.operators import scoring as SC
from tonekit.operators import trained as T

WORD = re.compile(r"[\w#@']{1,32}|[^\x00-\x20\w#@']")


def plain_features(text, max_tokens=128):
    t = re.sub(r"https?://\S+", "http", re.sub(r"@\w+", "@user", text or "")).strip(" ")
    w = WORD.findall(t.lower())[:max_tokens]
    return ([f"w{x}" for x in w] + [f"b{a} {b}" for a, b in zip(w, w[1:])]
            + ["c" + f" {x} "[i:i + 4] for x in w for i in range(max(1, len(x) - 1))])


TEXTS = ["", None, "one", "a b", "RT @Someone: stop https://t.co/xyz NOW!!", "naïve café - don't #tag_1 😀😀", "x" * 100, " \n\t ", "word " * 300]


def test_features_are_those_of_a_plain_loop(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    toks = df.withColumn("t", T.first_tokens(F.coalesce("text", F.lit("")))).withColumn("f", T.features(F.col("t")))
    got = {r.i: r for r in toks.select("i", "f", T.hashed(F.col("f")).alias("h")).collect()}
    for i, t in enumerate(TEXTS):
        want = plain_features(t)
        assert got[i].f == want
        assert got[i].h == [int(hashlib.md5(f.encode()).hexdigest()[:8], 16) % (1 << T.BITS) for f in want]


def test_truncation(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").select("text", T.truncated("text", 5).alias("cut"))
    for r in df.collect():
        if r.text is not None:
            assert r.text.startswith(r.cut)
            assert re.findall(WORD, r.cut) == re.findall(WORD, r.text)[:5]
    long = "good " * 200 + "angry " * 200
    rows = spark.createDataFrame([(1, long), (2, "good " * 128)], "msg_id long, text string")
    heads = [(K.EMOTIONS, True), (K.SENTIMENTS, False)]
    got = {r.msg_id: tuple(r)[1:] for r in SC.score_batches(rows, SC.lexicon_model(), heads, max_tokens=128).collect()}
    assert got[1] == pytest.approx(got[2])
    whole = {r.msg_id: r.anger for r in SC.score_batches(rows, SC.lexicon_model(), heads).collect()}
    assert whole[1] > got[1][0]  # without a limit the words far behind count


def sample(spark, n=400):
    r = np.random.default_rng(4)
    rows = []
    for i in range(n):
        a, b = r.integers(0, 2, 2)
        c = r.integers(0, 3)
        words = ["stop" if a else "go", "moon" if b else "sun", ["uno", "due", "tre"][c]] + [str(x) for x in r.integers(0, 30, 6)]
        r.shuffle(words)
        rows.append((i, " ".join(words), float(a), None if i % 7 == 0 else float(b), *[float(c == k) for k in range(3)]))
    return spark.createDataFrame(rows, "i int, text string, a double, b double, x double, y double, z double")


HEADS = ((("a", "b"), True), (("x", "y", "z"), False))


def plain_fit(rows, rounds, bits):
    """The same steps over a dense matrix."""
    size = 1 << bits
    X = np.zeros((len(rows), size + 1))
    for i, r in enumerate(rows):
        fs = plain_features(r.text)
        for f in fs:
            X[i, int(hashlib.md5(f.encode()).hexdigest()[:8], 16) % size] += 1 / len(fs)
    X[:, size] = 1
    Y = np.array([[np.nan if v is None else v for v in (r.a, r.b, r.x, r.y, r.z)] for r in rows])
    known, bend, ridge = ~np.isnan(Y), np.array([.25, .25, .5, .5, .5]), np.full((size + 1, 1), T.RIDGE)
    ridge[size] = 0
    scale = 2 * bend * (X.T @ known) + ridge
    w, was, t = np.zeros((size + 1, 5)), np.zeros((size + 1, 5)), 1.0
    for _ in range(rounds):
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, t = w + (t - 1) / t2 * (w - was), t2
        z = X @ v
        e = np.exp(z[:, 2:] - z[:, 2:].max(1, keepdims=True))
        p = np.hstack([1 / (1 + np.exp(-z[:, :2])), e / e.sum(1, keepdims=True)])
        g = X.T @ np.where(known, p - np.nan_to_num(Y), 0)
        was, w = w, v - (g + ridge * v) / np.where(scale == 0, 1, scale)
    return w[:size], w[size]


def test_fit_is_the_plain_descent(spark):
    df = sample(spark, 120).repartition(5)
    model = T.fit(df, HEADS, bits=9, rounds=7)
    w, b = plain_fit(df.collect(), 7, 9)
    assert np.allclose(model.weights, w, atol=1e-9) and np.allclose(model.bias, b, atol=1e-9)
    again = T.fit(df.repartition(2), HEADS, bits=9, rounds=7)
    assert np.allclose(again.weights, model.weights, atol=1e-9)


def test_fit_learns_and_scores(spark):
    df = sample(spark)
    model = T.fit(df.filter("i < 300"), HEADS, bits=12, rounds=30)
    assert all(later[k] < first[k] for first, later in zip(model.history, model.history[5:]) for k in (0, 1))
    held = T.score(df.filter("i >= 300").select("i", "text", *[F.col(c).alias(f"t_{c}") for c in "abxyz"]), model)
    assert held.columns[-5:] == list("abxyz")
    rows = held.collect()
    assert all(abs(r.x + r.y + r.z - 1) < 1e-9 for r in rows)
    right = [((r.a > .5) == (r.t_a > .5), r.t_b is None or (r.b > .5) == (r.t_b > .5), max("xyz", key=lambda c: r[c]) == max("xyz", key=lambda c: r[f"t_{c}"]))
             for r in rows]
    assert np.mean(right, axis=0).min() > 0.95
    loss = held.agg(T.log_loss(held, ["t_x", "t_y", "t_z"], False, ["x", "y", "z"])).first()[0]
    assert loss == pytest.approx(np.mean([-math.log(max(r.x * r.t_x, r.y * r.t_y, r.z * r.t_z)) for r in rows]))


def test_weights_travel_as_a_table(spark, tmp_path):
    df = sample(spark, 60)
    model = T.fit(df, HEADS, bits=8, rounds=3)
    model.table(spark).write.parquet(str(tmp_path / "w"))
    back = T.Model.from_table(spark.read.parquet(str(tmp_path / "w")), HEADS, bits=8)
    assert np.array_equal(back.weights, model.weights) and np.array_equal(back.bias, model.bias) and back.heads == model.heads
    a, b = (sorted(tuple(r) for r in T.score(df.select("i", "text"), m).collect()) for m in (model, back))
    assert a == b


def test_nothing_to_fit_or_score(spark):
    df = sample(spark, 10)
    model = T.fit(df.filter("false"), HEADS, bits=6, rounds=2)
    assert not model.weights.any() and not model.bias.any()
    assert T.score(df.select("text").filter("false"), model).count() == 0
    row = T.score(spark.createDataFrame([(None,)], "text string"), model).first()
    assert (row.a, row.b) == (0.5, 0.5) and row.x == pytest.approx(1 / 3)


def test_fourteen_heads_follow_a_teacher(spark):
    """The published shape: eleven sigmoid heads and one softmax head, fitted to another scorer's
    probabilities; on held-out texts it is closer to them than their mean is."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    heads = ((tuple(K.EMOTIONS), True), (tuple(K.SENTIMENTS), False))
    taught = SC.lexicon_scores(docs.withColumn("text", T.truncated("text")))
    model = T.fit(taught.filter("doc_id % 4 <> 0"), heads, bits=12)
    names = model.labels
    mean = taught.filter("doc_id % 4 <> 0").agg(*[F.avg(c).alias(c) for c in names]).first()
    held = T.score(taught.filter("doc_id % 4 = 0").select("text", *[F.col(c).alias(f"t_{c}") for c in names]), model)
    for labels, multilabel in heads:
        target = [f"t_{c}" for c in labels]
        own, constant = held.agg(T.log_loss(held, target, multilabel, labels),
                                 T.log_loss(held, target, multilabel, [F.lit(mean[c]) for c in labels])).first()
        assert own < constant
