"""Trained linear scorer (M1, M2): several heads fitted and applied together by Spark.

A text is cut to its first ``MAX_TOKENS`` tokens, and those become hashed features: words, pairs
of neighbouring words, and runs of four characters inside words. A head is a set of labels with
either independent probabilities (sigmoid) or one distribution (softmax); targets may be 0/1 or
probabilities, so a head can also be fitted to another scorer's output. All heads share the
features and are linear in them, and fitted by cross-entropy with a ridge penalty.

The fit is full-batch and deterministic: accelerated gradient steps, each coordinate scaled by a
bound on its curvature (the sum of its feature over the examples), so there is no step size to
choose. A round is one pass: tasks add up the gradient of their rows over the hashed buckets and
one aggregate adds the tasks' sums. What reaches the driver and every task is a table of
``2**bits`` buckets by labels, whatever the number of examples.
"""
from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import text as TX
from ..session import materialize

Heads = Sequence[tuple[Sequence[str], bool]]

#: Tokens that are read of a text; the classifiers of the published scores were cut there, too.
MAX_TOKENS = 128
BITS = 15
ROUNDS = 16
RIDGE = 3e-4
#: A token: up to 32 letters, digits, ``_ # @ '``, or one other character that is no blank.
WORD = r"[\p{L}\p{N}_#@']{1,32}"
OTHER = r"[^\x00-\x20\p{L}\p{N}_#@']"
#: Runs of this many characters, with a blank before and after the word.
GRAM = 4
#: Bucket of the constant feature in a table of weights.
BIAS = -1


def truncated(text: str | Column, max_tokens: int = MAX_TOKENS) -> Column:
    """The text up to its ``max_tokens``-th token."""
    return F.regexp_extract(text, rf"^(?:[\x00-\x20]*(?:{WORD}|{OTHER})){{0,{max_tokens}}}", 0)


def first_tokens(text: str | Column, max_tokens: int = MAX_TOKENS) -> Column:
    """The first tokens of a text, in lower case, handles and links made alike (C17)."""
    head = truncated(F.lower(TX.model_input(text)), max_tokens)  # what follows is not taken apart
    return F.slice(F.regexp_extract_all(head, F.lit(f"{WORD}|{OTHER}"), F.lit(0)), 1, max_tokens)


def features(tokens: Column) -> Column:
    """Words (``w``), pairs of words (``b``) and character runs (``c``) of an array of tokens."""
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))),
                       F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))),
                       lambda a, b: F.concat(F.lit("b"), a, F.lit(" "), b))
    runs = F.flatten(F.transform(tokens, lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(w) + 3 - GRAM, F.lit(1))),
        lambda i: F.concat(F.lit("c"), F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(GRAM))))))
    return F.concat(F.transform(tokens, lambda w: F.concat(F.lit("w"), w)), pairs, runs)


def hashed(feats: Column, bits: int = BITS) -> Column:
    """Buckets of the features: the first 32 bits of their MD5, modulo ``2**bits``."""
    return F.transform(feats, lambda f: (F.conv(F.substring(F.md5(f), 1, 8), 16, 10).cast("long")
                                         % F.lit(1 << bits)).cast("int"))


def with_tokens(df: DataFrame, text: str, max_tokens: int) -> DataFrame:
    """``df`` with the first tokens of ``text`` (of null: none) in ``_tokens``."""
    return df.withColumn("_tokens", first_tokens(F.coalesce(F.col(text), F.lit("")), max_tokens))


#: Rows whose features are held at a time, and words whose buckets a task remembers.
ROWS, WORDS = 2000, 200_000


class Buckets:
    """:func:`hashed` of :func:`features` for lists of tokens, in the tasks: a word's own buckets are
    made once a task (up to WORDS words and runs are remembered), those of a pair of words once a batch."""

    def __init__(self, bits: int):
        self.size, self.known, self.grams = 1 << bits, {}, {}

    def _of(self, feature: str) -> int:
        return int.from_bytes(hashlib.md5(feature.encode("utf8")).digest()[:4], "big") % self.size

    def _run(self, gram: str) -> int:
        got = self.grams.get(gram)
        if got is None:
            if len(self.grams) >= WORDS:
                self.grams.clear()
            got = self.grams[gram] = self._of("c" + gram)
        return got

    def _word(self, w: str) -> np.ndarray:
        got = self.known.get(w)
        if got is None:
            if len(self.known) >= WORDS:
                self.known.clear()
            s = f" {w} "
            got = self.known[w] = np.array([self._of("w" + w), *[
                self._run(s[i:i + GRAM]) for i in range(max(len(w) + 3 - GRAM, 1))]], np.int64)
        return got

    def of(self, tokens) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, row) of every feature of a list column, in the order of the rows."""
        enc = tokens.flatten().dictionary_encode()
        words, at = enc.dictionary.to_pylist(), enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(tokens)), np.diff(tokens.offsets.to_numpy()))
        if not len(at):
            return at, row
        own = [self._word(w) for w in words]
        n = np.array([len(x) for x in own])
        start, each = np.cumsum(n) - n, n[at]
        # the buckets of token i stand at start[word of i] and after
        step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        singles, single_rows = np.concatenate(own)[np.repeat(start[at], each) + step], np.repeat(row, each)
        next_to = np.flatnonzero(row[1:] == row[:-1])
        code, which = np.unique(at[next_to] * len(words) + at[next_to + 1], return_inverse=True)
        pairs = np.array([self._of(f"b{words[a]} {words[b]}") for a, b in zip(*(x.tolist() for x in np.divmod(code, len(words))))],
                         np.int64)
        f, r = np.concatenate([singles, pairs[which]]), np.concatenate([single_rows, row[next_to]])
        order = np.argsort(r, kind="stable")
        return f[order], r[order]


def with_buckets(df: DataFrame, text: str, bits: int, max_tokens: int, name: str = "_f") -> DataFrame:
    """``df`` without ``text``, with the hashed features of it (of null: none)."""
    kept = [c for c in df.columns if c != text]

    def run(batches):
        buckets = Buckets(bits)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                f, row = buckets.of(b.column("_tokens"))
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(f, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], lists], [*kept, name])

    return with_tokens(df, text, max_tokens).select(*kept, "_tokens").mapInArrow(run, df.select(*kept).schema.add(name, ArrayType(IntegerType())))


@dataclass(frozen=True)
class Model:
    """Weights of fitted heads: ``weights[bucket, label]`` and one constant a label."""

    heads: tuple[tuple[tuple[str, ...], bool], ...]
    weights: np.ndarray
    bias: np.ndarray
    max_tokens: int = MAX_TOKENS
    #: mean cross-entropy of the examples by head, before each round
    history: tuple[tuple[float, ...], ...] = ()

    @property
    def labels(self) -> list[str]:
        return [label for names, _ in self.heads for label in names]

    @property
    def bits(self) -> int:
        return len(self.weights).bit_length() - 1

    def table(self, spark: SparkSession) -> DataFrame:
        """(bucket, a column a label), the constants in bucket BIAS; buckets without weight are left out."""
        used = np.flatnonzero(self.weights.any(axis=1))
        cols = {"bucket": pa.array(np.concatenate([[BIAS], used]), pa.int32())}
        for j, label in enumerate(self.labels):
            cols[label] = pa.array(np.concatenate([[self.bias[j]], self.weights[used, j]]), pa.float64())
        return spark.createDataFrame(pa.table(cols))

    @staticmethod
    def from_table(table: DataFrame, heads: Heads, bits: int = BITS, max_tokens: int = MAX_TOKENS) -> Model:
        """The model whose ``table`` was written; at most ``2**bits`` rows come to the driver."""
        fixed = _fixed(heads)
        labels = [label for names, _ in fixed for label in names]
        got = table.select("bucket", *labels).toArrow()
        bucket = got["bucket"].to_numpy()
        values = np.stack([got[label].to_numpy() for label in labels], axis=1)
        weights = np.zeros((1 << bits, len(labels)))
        weights[bucket[bucket != BIAS]] = values[bucket != BIAS]
        return Model(fixed, weights, values[bucket == BIAS].reshape(-1, len(labels)).sum(axis=0), max_tokens)


def _fixed(heads: Heads):
    return tuple((tuple(names), bool(multilabel)) for names, multilabel in heads)


def _spans(heads) -> list[tuple[int, int, bool]]:
    at, out = 0, []
    for names, multilabel in heads:
        out.append((at, at + len(names), multilabel))
        at += len(names)
    return out


def probabilities(logits: np.ndarray, heads) -> np.ndarray:
    p = np.empty_like(logits)
    for lo, hi, multilabel in _spans(heads):
        z = logits[:, lo:hi]
        if multilabel:
            p[:, lo:hi] = 1 / (1 + np.exp(-z))
        else:
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p[:, lo:hi] = e / e.sum(axis=1, keepdims=True)
    return p


def _lists(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, row of each value, 1 / length of its row) of a list column."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    return values, np.repeat(np.arange(len(sizes)), sizes), np.repeat(1 / np.maximum(sizes, 1), sizes)


def _logits(f, row, x, n: int, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(row, weights[f, j] * x, n) for j in range(weights.shape[1])], axis=1) + bias


def _pass(data: DataFrame, heads, size: int, state) -> tuple[np.ndarray, np.ndarray]:
    """One pass over the examples. Without ``state``: the sums of every feature over the rows that
    have a target, by label. With (weights, bias) in ``state``: the gradient. The second array
    holds the same of the constant feature, then the cross-entropy by head and its rows."""
    spans, labels = _spans(heads), sum(len(names) for names, _ in heads)

    def run(batches):
        total, extra = np.zeros((size, labels)), np.zeros(labels + 2 * len(spans))
        for b in batches:
            if not b.num_rows:
                continue
            f, row, x = _lists(b.column("_f"))
            y = b.column("_y").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, labels)
            known = ~np.isnan(y)
            if state is None:
                error = known.astype(float)
            else:
                p = probabilities(_logits(f, row, x, b.num_rows, *state.value), heads)
                error = np.where(known, p - np.nan_to_num(y), 0.0)
                for k, (lo, hi, multilabel) in enumerate(spans):
                    t, q = np.nan_to_num(y[:, lo:hi]), np.clip(p[:, lo:hi], 1e-300, 1.0)
                    h = t * np.log(q) + ((1 - t) * np.log(np.clip(1 - q, 1e-300, 1.0)) if multilabel else 0)
                    extra[labels + 2 * k] -= h[known[:, lo:hi]].sum()
                    extra[labels + 2 * k + 1] += known[:, lo:hi].sum() if multilabel else known[:, lo].sum()
            extra[:labels] += error.sum(axis=0)
            for j in range(labels):
                total[:, j] += np.bincount(f, error[row, j] * x, size)
        used = np.flatnonzero(total.any(axis=1))
        # the constant and the losses follow the buckets, a row for every ``labels`` of them
        tail = np.concatenate([extra, np.zeros(-len(extra) % labels)]).reshape(-1, labels)
        rows, where = np.vstack([total[used], tail]), np.concatenate([used, size + np.arange(len(tail))])
        yield pa.RecordBatch.from_arrays(
            [pa.array(where, pa.int32()), *[pa.array(rows[:, j]) for j in range(labels)]],
            ["bucket", *[f"g{j}" for j in range(labels)]])

    cols = [f"g{j}" for j in range(labels)]
    sums = data.mapInArrow(run, "bucket int, " + ", ".join(f"{c} double" for c in cols)).groupBy("bucket").agg(
        *[F.sum(c).alias(c) for c in cols]).toArrow()
    out = np.zeros((size + 1 + (2 * len(spans) + labels - 1) // labels + 1, labels))
    out[sums["bucket"].to_numpy()] = np.stack([sums[c].to_numpy() for c in cols], axis=1)
    return out[:size], out[size:].ravel()


def fit(examples: DataFrame, heads: Heads, text: str = "text", bits: int = BITS, rounds: int = ROUNDS,
        ridge: float = RIDGE, max_tokens: int = MAX_TOKENS) -> Model:
    """A :class:`Model` of ``heads``; ``examples`` has a target column for every label.

    A null target leaves the row out of its head (of a softmax head: if any of its targets is
    null). Null texts count as empty. Without examples all weights are zero. The hashed examples
    are written once (reliable checkpoint); each of the ``rounds + 1`` passes reads them.
    """
    fixed = _fixed(heads)
    spark = examples.sparkSession
    targets = []
    for names, multilabel in fixed:
        if multilabel:
            targets += [F.col(c).cast("double") for c in names]
        else:
            whole = F.lit(True)
            for c in names:
                whole = whole & F.col(c).isNotNull()
            targets += [F.when(whole, F.col(c).cast("double")) for c in names]
    data = materialize(with_buckets(examples.select(F.col(text).alias("_text"), F.array(*targets).alias("_y")), "_text",
                                    bits, max_tokens).select("_f", "_y"))
    size, labels = 1 << bits, len(targets)
    # second derivatives are at most 1/4 (sigmoid) or 1/2 (softmax) times the feature times the
    # row's sum of features, which is 1 plus the constant
    bend = np.concatenate([np.full(len(names), 0.25 if multilabel else 0.5) for names, multilabel in fixed])
    mass, extra = _pass(data, fixed, size, None)
    scale = 2 * bend * mass + ridge
    scale_bias = np.maximum(2 * bend * extra[:labels], 1e-300)
    w, b = np.zeros((size, labels)), np.zeros(labels)
    w_was, b_was, t, history = w, b, 1.0, []
    for _ in range(rounds):
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        push, t = (t - 1) / t_next, t_next
        v, c = w + push * (w - w_was), b + push * (b - b_was)
        state = spark.sparkContext.broadcast((v, c))
        gradient, extra = _pass(data, fixed, size, state)
        state.destroy()
        loss = extra[labels:labels + 2 * len(fixed)]
        history.append(tuple(float(x) for x in loss[::2] / np.maximum(loss[1::2], 1)))
        w_was, b_was = w, b
        w, b = v - (gradient + ridge * v) / scale, c - extra[:labels] / scale_bias
    return Model(fixed, w, b, max_tokens, tuple(history))


def score(df: DataFrame, model: Model, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with a probability column for each label, in one pass without a shuffle.

    The weights go to the tasks as one broadcast of ``2**bits`` by labels; a task holds one
    Arrow batch. Null texts count as empty."""
    spark = df.sparkSession
    state = spark.sparkContext.broadcast((model.weights, model.bias))
    heads, labels, bits = model.heads, model.labels, model.bits
    kept = list(df.columns if keep is None else keep)

    def run(batches):
        buckets = Buckets(bits)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                f, row = buckets.of(b.column("_tokens"))
                x = 1 / np.maximum(np.bincount(row, minlength=b.num_rows), 1)
                p = probabilities(_logits(f, row, x[row], b.num_rows, *state.value), heads)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *[pa.array(p[:, j]) for j in range(len(labels))]],
                                                 [*kept, *labels])

    schema = df.select(*kept).schema
    for label in labels:
        schema = schema.add(label, "double")
    return with_tokens(df, text, model.max_tokens).select(*kept, "_tokens").mapInArrow(run, schema)


def log_loss(df: DataFrame, head: Sequence[str], multilabel: bool, predicted: Sequence[str | Column]) -> Column:
    """Mean cross-entropy of predictions against the target columns of a head, as an aggregate."""
    tiny = F.lit(1e-9)

    def safe(p):
        return F.least(F.greatest(F.col(p) if isinstance(p, str) else p, tiny), F.lit(1.0) - tiny)

    terms = [F.col(y) * F.log(safe(p)) + ((F.lit(1.0) - F.col(y)) * F.log(F.lit(1.0) - safe(p)) if multilabel else F.lit(0.0))
             for y, p in zip(head, predicted)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return -F.avg(total)
