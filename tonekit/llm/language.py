"""Language identification as a mixture: which languages, and in what proportions.

Each language is a distribution over hashed byte n-grams, counted over all labelled rows.
A text is cut into stretches; a stretch's n-gram likelihood under each language is computed
once, and expectation-maximisation finds the proportions that explain the stretches best.
Languages enter in order of their share, as long as the penalised likelihood grows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, keyed, real_id, settled, sized_batches

GRAM = 4
BINS = 1 << 16
#: n-grams in a stretch, and the share of its evidence that counts: neighbouring n-grams overlap.
STRETCH = 48
SMOOTH = 0.5
#: Log-likelihood that a further language must add, times the log of the number of stretches.
PENALTY = 1.5
ROUNDS = 30
BATCH_BYTES = 1 << 20
UNKNOWN = "und"


def _grams(text: str) -> np.ndarray:
    """Bin of every GRAM-byte string of the lower-cased text, letters only.

    Whatever is no letter counts as one blank; a text without letters has no n-grams.
    """
    import regex

    words = regex.findall(r"\p{L}+", text.lower())
    if not words:
        return np.zeros(0, np.int64)
    raw = np.frombuffer((" " + " ".join(words) + "  ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    h = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
    h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(16)).astype(np.int64)


def train(rows: DataFrame) -> DataFrame:
    """(lang, bin, n): n-gram counts of each language over all of ``rows`` (text, lang).

    Every batch is counted before it is dealt out, so a language costs BINS rows a batch at most.
    """
    def run(batches):
        for b in sized_batches(batches, 4 << 20):
            sums: dict[str, np.ndarray] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                n = np.bincount(_grams(text), minlength=BINS)
                if lang in sums:
                    sums[lang] += n
                else:
                    sums[lang] = n
            for lang, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bin": at, "n": n[at]})

    part = bounded_batches(rows).filter("lang is not null").select("lang", F.coalesce("text", F.lit("")).alias("text"))
    return (part.mapInArrow(run, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")))


def log_likelihoods(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each bin under each): BINS numbers a language."""
    rows = counts.groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("c")).orderBy("lang")
    langs, tables = [], []
    for r in rows.toLocalIterator():
        n = np.full(BINS, SMOOTH)
        for b, c in r["c"]:
            n[b] += c
        langs.append(r["lang"])
        tables.append(np.log(n / n.sum()))
    return langs, np.array(tables, np.float32).reshape(len(langs), BINS)


def _mixture(like: np.ndarray, starts: np.ndarray, allowed: np.ndarray):
    """(log-likelihood, shares) of each text by expectation-maximisation over its stretches.

    ``like`` holds a row per stretch (log-likelihood of each language), ``starts`` the first
    stretch of each text, ``allowed`` the languages each text may use.
    """
    size = np.diff(np.append(starts, len(like)))
    of = np.repeat(np.arange(len(starts)), size)
    masked = np.where(allowed[of], like, -np.inf)
    top = masked.max(axis=1, keepdims=True)
    p = np.exp(masked - top)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        weight = p * share[of]
        weight /= weight.sum(axis=1, keepdims=True)
        new = np.add.reduceat(weight, starts) / size[:, None]
        moved = np.abs(new - share).max(initial=0)
        share = new
        if moved < 1e-4:
            break
    score = np.log((p * share[of]).sum(axis=1)) + top[:, 0]
    return np.add.reduceat(score, starts), share


def mixtures(like: np.ndarray, starts: np.ndarray, penalty: float = PENALTY):
    """(chosen, shares): for each text the language set of highest penalised likelihood among
    the nested sets that add languages in order of their share in the full mixture."""
    n, k = len(starts), like.shape[1]
    size = np.diff(np.append(starts, len(like)))
    _, full = _mixture(like, starts, np.ones((n, k), bool))
    order = np.argsort(-full, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(k)[None, :].repeat(n, 0), axis=1)
    best, share = np.full(n, -np.inf), np.zeros((n, k))
    go = np.arange(n)
    for s in range(1, k + 1):
        pick = np.zeros(n, bool)
        pick[go] = True
        rows = np.repeat(pick, size)
        first = np.cumsum(size[go]) - size[go]
        score, got = _mixture(like[rows], first, rank[go] < s)
        score = score - penalty * s * np.log(size[go] + 1)
        better = score > best[go]
        best[go[better]], share[go[better]] = score[better], got[better]
        go = go[better]
        if not len(go):
            break
    return share > 0, share


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
            penalty: float = PENALTY) -> DataFrame:
    """(doc_id, lang_pred, score, langs, shares) of every row: the language of the largest share,
    that share, and the chosen set."""
    def run(batches):
        for b in sized_batches(batches, BATCH_BYTES):
            grams = [_grams(t.as_py()) for t in b.column("text")]
            pred, score = [UNKNOWN] * len(grams), np.zeros(len(grams))
            chosen, parts = [[] for _ in grams], [[] for _ in grams]
            has = [i for i, g in enumerate(grams) if len(g) and langs]
            if has:
                size = np.array([len(grams[i]) for i in has])
                flat = np.concatenate([grams[i] for i in has])
                begin = np.cumsum(size) - size
                stretches = -(-size // STRETCH)
                starts = np.cumsum(stretches) - stretches
                at = np.repeat(begin, stretches) + STRETCH * (np.arange(stretches.sum()) - np.repeat(starts, stretches))
                # neighbouring n-grams share all but one byte: their evidence is a quarter each
                like = np.stack([np.add.reduceat(t[flat], at, dtype=np.float64) for t in table], axis=1) / GRAM
                _, share = mixtures(like, starts, penalty)
                top = share.argmax(axis=1)
                for r, i in enumerate(has):
                    pred[i], score[i] = langs[top[r]], min(1.0, max(0.0, share[r, top[r]]))
                    chosen[i] = [langs[j] for j in np.flatnonzero(share[r] > 0)]
                    parts[i] = share[r][share[r] > 0].tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column("did"), pa.array(pred, pa.string()), pa.array(score), pa.array(chosen, pa.list_(pa.string())),
                 pa.array(parts, pa.list_(pa.float64()))], ["doc_id", "lang_pred", "score", "langs", "shares"])

    return keyed(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, langs, shares.

    Languages are learned from the rows whose crc32(id as text) mod 3 is not 1 and whose lang is
    not null, all of them; the rest is held out. A prediction sees the text alone. Null texts and
    texts without a letter are ``und`` with score 0, as is everything where nothing was learned.
    Null ids are taken as the text '' for the split. Repeated rows are predicted row by row,
    other columns are not read, ties go to the language that sorts first. An empty table gives
    no rows.
    """
    def held(c):
        return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 3 == 1

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = settled(train(rows.filter(~held(F.col("i")))), "grams")
    langs, table = log_likelihoods(counts)
    out = predict(docs, langs, table, id_col, text_col).withColumn("doc_id", real_id("doc_id"))
    return out.withColumn("held_out", held(F.col("doc_id")))


