"""Document quality by hierarchical empirical Bayes.

A classifier on how a text is made up gives each document a log likelihood ratio. Hosts and
the paths under them have quality rates: a host's is shrunk toward the global rate and a
path's toward its host's, the more the less is known of it; how much is estimated from the
spread between hosts (paths) by moments. A document's posterior is its own evidence on top of
its path's rate, counted without the document itself.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, bounded_batches, lowest, real_id, settled, sized_batches, text_key

#: Labelled documents that the classifier is fitted on at most (those of smallest id hash).
SAMPLE = 20_000
BINS = 16
RIDGE = 1.0
KEEP = 0.5
BATCH_BYTES = 8 << 20

_LETTERS = bytes(b for b in range(256) if chr(b).isascii() and chr(b).isalpha() or b >= 0x80)
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_BLANKS = b" \t\n\r\x0b\x0c"
_STOPS = b".,;:'\"()-"
FEATURES = ("letters", "upper", "digits", "stops", "symbols", "word_length", "distinct_words", "top_word",
            "same_word_runs", "words_with_symbols", "capital_words", "distinct_lines", "line_length", "length")


def describe(text: str) -> list[float]:
    """The features of one text, each about 0 to 1; an empty text is all zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)

    def share(kind: bytes) -> float:
        return (n - len(raw.translate(None, kind))) / n

    letters, blanks = share(_LETTERS), share(_BLANKS)
    digits, stops = share(_DIGITS), share(_STOPS)
    m, counts = len(words), Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    odd = sum(c for w, c in counts.items() if w.translate(None, _LETTERS + _DIGITS + _STOPS))
    capital = sum(c for w, c in counts.items() if len(w) > 1 and w[:2].isupper())
    return [letters, share(_UPPER) / max(letters, 1e-9), digits, stops, max(0.0, 1 - letters - blanks - digits - stops),
            min(1.0, (n - blanks * n) / m / 20), len(counts) / m, max(counts.values()) / m,
            sum(map(bytes.__eq__, words, words[1:])) / m, odd / m, capital / m, len(set(lines)) / len(lines),
            min(1.0, n / len(lines) / 2000), min(1.0, float(np.log1p(m)) / 12)]


def features(docs: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, th, host, path, f): features of every row; null host or path counts as ''."""
    base = bounded_batches(docs).select(F.col(id_col), F.col(text_col), F.coalesce(host, F.lit("")).alias("_h"),
                       F.coalesce(path, F.lit("")).alias("_p"))
    rows = base.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("did"),
                       text_key(text_col).alias("th"), F.col("_h").alias("host"), F.col("_p").alias("path"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for b in sized_batches(batches, BATCH_BYTES):
            f = [describe(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("did", "th", "host", "path")]
                                             + [pa.array(f, pa.list_(pa.float64()))], ["did", "th", "host", "path", "f"])

    return rows.mapInArrow(run, "did long, th long, host string, path string, f array<double>")


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, ridge: float = RIDGE):
    """(cuts, weights): additive logistic regression over quantile bins of each feature.

    ``weights`` sum to the log likelihood ratio: the intercept, less the sample's prior, is
    spread over the first feature. Without both classes every weight is zero.
    """
    k = len(FEATURES)
    if len(y) == 0 or y.min() == y.max():
        return np.zeros((k, bins - 1)), np.zeros((k, bins))
    cuts = np.quantile(x, np.arange(1, bins) / bins, axis=0).T
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) + np.arange(k) * bins
    design = np.zeros((len(y), k * bins + 1))
    np.put_along_axis(design, code, 1.0, axis=1)
    design[:, -1] = 1
    w = np.zeros(k * bins + 1)
    penalty = np.full(k * bins + 1, ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.diag(penalty),
                               design.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    weights = w[:-1].reshape(k, bins)
    weights[0] += w[-1] - np.log(y.mean() / (1 - y.mean()))
    return cuts, weights


def evidence(feats: DataFrame, cuts: np.ndarray, weights: np.ndarray) -> DataFrame:
    """``feats`` with the log likelihood ratio of good to bad instead of the features."""
    def run(batches):
        for b in batches:
            x = b.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            s = sum(weights[j][np.searchsorted(cuts[j], x[:, j], side="left")] for j in range(len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("did", "th", "host", "path", "label")),
                                              pa.array(np.asarray(s, float) + np.zeros(len(x)))],
                                             ["did", "th", "host", "path", "label", "evidence"])

    return feats.mapInArrow(run, "did long, th long, host string, path string, label double, evidence double")


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _inner(p: Column) -> Column:
    return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))


def strength(groups: DataFrame, prior: Column) -> float:
    """Pseudo-count m of the prior Beta(m * prior, m * (1 - prior)) of ``groups`` (n, k), by moments:
    what the spread of rates k / n exceeds that of chance. Without excess it is large."""
    p = _inner(prior)
    r = groups.agg(F.sum(F.pow(F.col("k") / F.col("n") - p, 2) * F.col("n")), F.sum(p * (1 - p)),
                   F.sum("n"), F.sum(F.pow("n", 2)), F.count("*"), F.sum(p * (1 - p) * F.col("n"))).first()
    spread, chance, n, squares, groups_n, each = (float(v or 0) for v in r)
    if groups_n < 2 or n - squares / n <= 0:
        return 1e4
    between = (spread - chance * (groups_n - 1) / groups_n) / (n - squares / n)
    return float(min(1e4, max(1.0, (each / n) / between - 1))) if between > 0 else 1e4


def posterior(scored: DataFrame) -> DataFrame:
    """Adds host_rate, path_rate and p_quality to ``scored`` (host, path, label, evidence).

    Each document counts with its label, or else with its probability by evidence alone. Rates
    are sums by host and by path (a host with a third of all documents is one row a task).
    """
    counted = scored.agg(F.avg("label"), F.count("label")).first()
    start = min(1 - 1e-3, max(1e-3, counted[0])) if counted[1] else 0.5
    soft = scored.withColumn("y", F.coalesce("label", 1 / (1 + F.exp(-F.col("evidence") - float(np.log(start / (1 - start)))))))
    paths = settled(soft.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("k")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = hosts.agg(F.sum("n"), F.sum("k")).first()
    rate = float(total[1] / total[0]) if total[0] else start
    m = strength(hosts, F.lit(rate))
    hosts = settled(hosts.select("host", F.col("n").alias("hn"), F.col("k").alias("hk"),
                                 ((F.col("k") + m * rate) / (F.col("n") + m)).alias("host_rate")), "hosts")
    paths = settled(paths.join(hosts, "host"), "paths")
    mp = strength(paths, F.col("host_rate"))
    own_host = (F.col("hk") - F.col("y") + m * rate) / (F.col("hn") - 1 + m)
    own = (F.col("k") - F.col("y") + mp * own_host) / (F.col("n") - 1 + mp)
    return (soft.join(paths, ["host", "path"])
            .withColumn("path_rate", (F.col("k") + mp * F.col("host_rate")) / (F.col("n") + mp))
            .withColumn("p_quality", 1 / (1 + F.exp(-F.col("evidence") - _logit(_inner(own))))))


def assess(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None,
           sample: int = SAMPLE, threshold: float = KEEP) -> DataFrame:
    """One row per document: doc_id, evidence, host_rate, path_rate, p_quality, keep, text_key.

    ``host`` and ``path`` default to source and source/lang. ``labels`` (doc_id, quality): nulls
    are left out, of repeated ids the lowest quality counts; without both classes the evidence is
    zero and every document stands at its path's rate. Null hosts and paths are a group of their
    own; null and empty texts have zero features; rows are judged one by one, also repeated ones.
    Other columns are not read. No documents, no rows.
    """
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.col("source"), F.col("lang")) if path is None else path
    known = labels.filter("doc_id is not null and quality is not null").groupBy(
        F.col("doc_id").cast("long").alias("did")).agg(F.min("quality").cast("double").alias("label"))
    feats = settled(features(docs, host, path).join(known, "did", "left"), "features")
    some = (lowest(feats.filter("label is not null").select("f", "label", "did", "th"), F.xxhash64("did"), sample)
            .orderBy(F.xxhash64("did"), "th").limit(sample).select("f", "label").toArrow())
    y = some.column("label").to_numpy()
    x = np.array(some.column("f").to_pylist(), float).reshape(-1, len(FEATURES))
    scored = settled(evidence(feats, *fit(x, y)), "evidence")
    return posterior(scored).select(
        real_id().alias("doc_id"), "evidence", "host_rate", "path_rate", "p_quality",
        (F.col("p_quality") >= threshold).alias("keep"), F.col("th").alias("text_key"))
