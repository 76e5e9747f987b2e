"""Batch scoring.

Two paths:

* ``score_batches`` -- any Python model behind a factory, run with ``mapInPandas``:
  the model is built once per task, texts are sorted by length inside each
  partition to cut padding (M4), batches go through Arrow, and all heads are scored
  in one pass.  The stand-in model computes the lexicon scores, so the path runs
  without downloaded weights and SQL can check it.
* ``lexicon_scores`` -- a deterministic scorer written entirely in Spark SQL
  expressions (word-list hits plus punctuation and capitals), evaluated in the JVM;
  the word-list steps are array functions with lambdas, which run outside
  whole-stage codegen.  It is a stand-in, not the classifiers the published figures
  came from.
"""
from __future__ import annotations

import string
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import text as TX
from .sampling import hash_bin, hash_cut

# Word lists of the lexicon scorer (ours; short on purpose -- callers pass their own).
LEXICON = {
    "anger": ["angry", "outrage", "furious", "disgrace", "shameful", "attack", "worthless"],
    "disgust": ["disgusting", "corrupt", "sick", "vile", "gross"],
    "fear": ["afraid", "threat", "danger", "crisis", "risk"],
    "sadness": ["sad", "loss", "grief", "mourn", "tragic"],
    "joy": ["happy", "great", "congratulations", "celebrate", "wonderful"],
    "optimism": ["hope", "future", "forward", "better", "build"],
    "love": ["love", "family", "heart", "dear"],
    "trust": ["trust", "license", "licensed", "secure", "reliable"],
    "anticipation": ["soon", "next", "tomorrow", "await", "upcoming"],
    "pessimism": ["never", "worse", "fail", "doomed"],
    "surprise": ["wow", "unexpected", "suddenly", "shock"],
    "negative": ["not", "no", "bad", "wrong"],
    "neutral": ["the", "of", "and", "is"],
    "positive": ["good", "thanks", "great", "best"],
}
# per label: (bias, weight of hits, weight of log(1 + '!'), weight of capital share)
WEIGHTS = {
    "anger": (-1.0, 0.9, 0.8, 3.0), "disgust": (-1.6, 0.9, 0.4, 2.0), "fear": (-1.8, 0.8, 0.2, 1.0),
    "sadness": (-1.9, 0.8, 0.0, 0.5), "joy": (-0.6, 0.7, 0.5, -2.0), "optimism": (-0.4, 0.6, 0.2, -3.0),
    "love": (-2.0, 0.8, 0.3, 0.0), "trust": (-1.2, 0.7, -0.3, -1.0), "anticipation": (-1.5, 0.6, 0.2, 0.0),
    "pessimism": (-1.7, 0.7, 0.1, 1.0), "surprise": (-2.2, 0.8, 0.9, 1.0),
    "negative": (0.0, 0.3, 0.6, 2.0), "neutral": (0.5, 0.05, -0.4, -1.0), "positive": (0.0, 0.3, 0.2, -1.0),
}


def _features(text: Column) -> dict[str, Column]:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    n_chars = F.greatest(F.length(text), F.lit(1))
    excl = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    # not by translate, which looks every character up in a map
    caps = F.length(text) - F.length(F.regexp_replace(text, F.lit("[A-Z]+"), F.lit("")))
    return {"words": words, "excl": F.log1p(excl.cast("double")), "caps": caps / n_chars}


def lexicon_logits(words: Column, excl: Column, caps: Column,
                   labels: Sequence[str] = tuple(K.EMOTIONS) + tuple(K.SENTIMENTS)) -> dict[str, Column]:
    """M5 inputs: one logit column per label from word-list hits, punctuation and capitals."""
    out = {}
    for lab in labels:
        hits = F.size(F.filter(words, lambda w: w.isin(*LEXICON[lab]))).cast("double")
        b, wh, we, wc = WEIGHTS[lab]
        out[lab] = F.lit(b) + F.lit(wh) * F.log1p(hits) + F.lit(we) * excl + F.lit(wc) * caps
    return out


def sigmoid(x: Column) -> Column:
    """M5: logistic function."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softmax(cols: Sequence[Column]) -> list[Column]:
    """M5: softmax over a few logit columns (max-shifted for stability)."""
    m = F.greatest(*cols)
    ex = [F.exp(c - m) for c in cols]
    total = ex[0]
    for e in ex[1:]:
        total = total + e
    return [e / total for e in ex]


def lexicon_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """M1/M2 (SQL path): 11 independent emotion probabilities (sigmoid) and three
    sentiment probabilities (softmax) on the model-normalised text (C17).

    Built in stages (features, then logits, then probabilities) so each expensive
    expression -- the word array above all -- is computed once per row; Catalyst keeps
    such projections apart instead of inlining a non-cheap expression many times."""
    labels = list(K.EMOTIONS) + list(K.SENTIMENTS)
    t = df.select("*", TX.model_input(text).alias("_t"))
    f = _features(F.col("_t"))
    vocab = sorted({w for lab in labels for w in LEXICON[lab]})
    # keep only lexicon words (one InSet pass); the per-label counts then scan a tiny array
    d = t.select(*[F.col(c) for c in df.columns], F.filter(f["words"], lambda w: w.isin(*vocab)).alias("_w"),
                 f["excl"].alias("_e"), f["caps"].alias("_c"))
    logits = lexicon_logits(F.col("_w"), F.col("_e"), F.col("_c"), labels)
    d = d.select(*[F.col(c) for c in df.columns], *[logits[l].alias(f"_l_{l}") for l in labels])
    emo = [sigmoid(F.col(f"_l_{e}")).alias(e) for e in K.EMOTIONS]
    sent = [c.alias(n) for c, n in zip(softmax([F.col(f"_l_{s}") for s in K.SENTIMENTS]), K.SENTIMENTS)]
    return d.select(*[F.col(c) for c in df.columns], *emo, *sent)


def score_record(df: DataFrame, labels: Sequence[str] = tuple(K.EMOTIONS) + tuple(K.SENTIMENTS),
                 digits: int = 4) -> DataFrame:
    """M3: scores rounded to 4 dp plus the ``angry`` flag tested on the rounded value."""
    out = df.select(*[c for c in df.columns if c not in labels], *[F.round(l, digits).alias(l) for l in labels])
    return out.withColumn("angry", F.col("anger") > K.ANGRY_THRESHOLD)


def report_labels(df: DataFrame, labels: Sequence[str] = tuple(K.EMOTIONS), floor: float = 0.1) -> Column:
    """M7: the labels scoring at least ``floor``, highest first (ties by label order)."""
    arr = F.array(*[F.struct(F.col(l).alias("p"), F.lit(i).alias("i"), F.lit(l).alias("label"))
                    for i, l in enumerate(labels)])
    kept = F.filter(arr, lambda s: s["p"] >= floor)
    ordered = F.array_sort(kept, lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1)
                           .otherwise(a["i"] - b["i"]))
    return F.transform(ordered, lambda s: F.struct(s["label"].alias("label"), s["p"].alias("p")))


# ---- Python-model path -------------------------------------------------------------------

def lexicon_model(labels: Sequence[str] = tuple(K.EMOTIONS) + tuple(K.SENTIMENTS)):
    """Factory of a Python model with the logits of :func:`lexicon_logits`, one column per
    label; stands in for a downloaded classifier, and the SQL scorer reproduces it."""

    def build():
        import re
        from collections import Counter

        column = {}
        for j, lab in enumerate(labels):
            for w in LEXICON[lab]:
                column.setdefault(w, []).append(j)
        b, wh, we, wc = (np.array([WEIGHTS[lab][i] for lab in labels]) for i in range(4))
        drop_caps = str.maketrans("", "", string.ascii_uppercase)
        find = re.compile("[a-z]+").findall

        def predict(texts: list[str]) -> np.ndarray:
            hits = np.zeros((len(texts), len(labels)))
            excl, caps = np.zeros(len(texts)), np.zeros(len(texts))
            for i, t in enumerate(texts):
                counts = Counter(find(t.lower()))
                for w in counts.keys() & column.keys():
                    hits[i, column[w]] += counts[w]
                excl[i] = t.count("!")
                caps[i] = (len(t) - len(t.translate(drop_caps))) / max(1, len(t))
            return b + wh * np.log1p(hits) + we * np.log1p(excl)[:, None] + wc * caps[:, None]

        return predict

    return build


def score_batches(df: DataFrame, factory: Callable[[], Callable[[list[str]], np.ndarray]],
                  heads: Sequence[tuple[Sequence[str], bool]], id_col: str = "msg_id", text: str = "text",
                  batch_size: int = 256, max_tokens: int | None = None) -> DataFrame:
    """M1/M2/M4: score texts with a Python model in Arrow batches, all heads in one pass.

    ``heads``: (labels, multilabel) of consecutive logit columns -- independent sigmoids, or
    a softmax.  Rows are sorted by text length within each partition (no shuffle) so batches
    hold texts of similar length; the model is created once per task.  A null text is
    scored as an empty one; ``max_tokens`` cuts texts after that many tokens."""
    names = [lab for labels, _ in heads for lab in labels]
    schema = T.StructType([df.schema[id_col]] + [T.StructField(n, T.DoubleType()) for n in names])
    from .trained import truncated

    t = TX.model_input(text)
    t = truncated(t, max_tokens) if max_tokens else t
    src = df.select(id_col, t.alias("_t")).sortWithinPartitions(F.length("_t"))
    bounds = np.cumsum([0] + [len(labels) for labels, _ in heads]).tolist()

    def run(batches):
        predict = factory()
        for pdf in batches:
            texts = pdf["_t"].fillna("").tolist()
            outs = []
            for i in range(0, len(texts), batch_size):
                p = predict(texts[i:i + batch_size])
                for (_, multilabel), lo, hi in zip(heads, bounds, bounds[1:]):
                    z = p[:, lo:hi]
                    e = np.exp(z - z.max(1, keepdims=True))
                    p[:, lo:hi] = 1.0 / (1.0 + np.exp(-z)) if multilabel else e / e.sum(1, keepdims=True)
                outs.append(p)
            res = pd.DataFrame(np.vstack(outs) if outs else np.zeros((0, len(names))), columns=names)
            res.insert(0, id_col, pdf[id_col].values)
            yield res

    return src.mapInPandas(run, schema)


def repeatable_sample(df: DataFrame, n: int, seed: int, key: str = "msg_id") -> DataFrame:
    """Exactly ``n`` rows, the same ones on every run and engine: order by the MD5 of
    seed and id and keep the first ``n``.

    A first pass over the ids finds a hash up to which at least ``n`` and hardly more rows lie
    (:func:`hash_cut`); the second takes those, so the last task gets about ``n`` rows however many
    tasks there are, instead of ``n`` from each."""
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    cut = hash_cut(df.select(text.alias("_h")), "_h", n)
    few = df.withColumn("_h", text).withColumn("_b", hash_bin("_h")).filter(F.col("_b") <= cut.scalar())
    return few.orderBy("_h", key).limit(n).drop("_h", "_b")


def model_comparison(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """M6: mean probability per label and the share of rows where it is the arg-max."""
    arr = F.array(*[F.struct(F.col(l).alias("p"), F.lit(-i).alias("neg_i"), F.lit(l).alias("label"))
                    for i, l in enumerate(labels)])
    top = F.array_max(arr)["label"]
    d = df.withColumn("_top", top)
    means = [F.avg(l).alias(f"mean_{l}") for l in labels]
    shares = [F.avg((F.col("_top") == l).cast("int")).alias(f"top_{l}") for l in labels]
    return d.agg(*means, *shares)


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of score columns, long format, one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("r"))
                     for a, b in pairs])
    return one.select(F.inline(rows))
