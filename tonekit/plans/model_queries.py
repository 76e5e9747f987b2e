"""Trained scorer over the labelled documents (M1, M2).

The heads are what the driver tables have labels for: quality and toxic (independent) and the
language (one distribution). A fifth of the labelled documents, by a hash of the id, is held out.
"""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import trained as T
from ..operators.scoring import lexicon_scores
from ..sources.files import read_table
from . import oracle_views as O
from .registry import register

LANGS = ("de", "en", "es", "fr")
HEADS = ((("quality", "toxic"), True), (LANGS, False))
LABELS = [label for names, _ in HEADS for label in names]
HELD_OUT = ("0", "1", "2")  # first hex digit of the id's MD5


def _held_out(doc_id="doc_id"):
    return F.substring(F.md5(F.col(doc_id).cast("string")), 1, 1).isin(*HELD_OUT)


def _labelled(spark, root):
    docs = read_table(spark, root, "documents", ["doc_id", "text", "lang"])
    labels = read_table(spark, root, "labels", ["doc_id", "quality", "toxic"])
    return docs.join(labels, "doc_id").select(
        "doc_id", "text", "quality", "toxic", *[(F.col("lang") == lang).cast("int").alias(lang) for lang in LANGS])


def _model(spark, root):
    return T.fit(_labelled(spark, root).filter(~_held_out()), HEADS)


# ---- the same fit in SQL: features as rows, a round as joins and sums ------------------------
_OUT = f"md5(CAST(doc_id AS VARCHAR))[1:1] IN ({', '.join(repr(d) for d in HELD_OUT)})"


def _each(form: str, labels=LABELS) -> str:
    return ", ".join(form.format(c=c) for c in labels)


def _softmax(prefix: str = "") -> str:
    top = f"greatest({_each(prefix + '{c}', LANGS)})"
    den = " + ".join(f"exp({prefix}{c} - {top})" for c in LANGS)
    return ", ".join(f"exp({prefix}{c} - {top}) / ({den}) AS {c}" for c in LANGS)


def _fit_sql(rounds: int = T.ROUNDS) -> str:
    """CTEs x (features of every document), y (training targets) up to the fitted weights ``w``."""
    pattern = r"[\p{L}\p{N}_#@'']{1,32}|[^\x00-\x20\p{L}\p{N}_#@'']"
    text = (r"trim(regexp_replace(regexp_replace(coalesce(text, ''), '@[\p{L}\p{N}_]+', '@user', 'g'), "
            r"'https?://\S+', 'http', 'g'))")
    ctes = [
        f"tok AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower({text}), '{pattern}')[1:{T.MAX_TOKENS}] AS w FROM documents)",
        "one AS (SELECT doc_id, unnest(w) AS t FROM tok)",
        f"""feat AS (SELECT doc_id, 'w' || t AS f FROM one
  UNION ALL SELECT doc_id, 'b' || w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM tok) q
  UNION ALL SELECT doc_id, 'c' || substr(' ' || t || ' ', i, {T.GRAM})
            FROM (SELECT doc_id, t, unnest(range(1, greatest(length(t) + {3 - T.GRAM}, 1) + 1)) AS i FROM one) q)""",
        f"hash AS (SELECT doc_id, CAST('0x' || md5(f)[1:8] AS BIGINT) % {1 << T.BITS} AS j, count(*) AS n FROM feat GROUP BY ALL)",
        f"""x AS MATERIALIZED (SELECT doc_id, j, n / sum(n) OVER (PARTITION BY doc_id) AS x FROM hash
  UNION ALL SELECT doc_id, {T.BIAS}, 1 FROM documents)""",
        f"y AS MATERIALIZED (SELECT doc_id, quality, toxic, {', '.join(f'CAST(lang = {lang!r} AS INTEGER) AS {lang}' for lang in LANGS)} "
        f"FROM documents JOIN labels USING (doc_id) WHERE NOT {_OUT})",
        "tx AS MATERIALIZED (SELECT x.* FROM x SEMI JOIN y USING (doc_id))",
        f"ridge AS MATERIALIZED (SELECT j, CASE WHEN j = {T.BIAS} THEN 0 ELSE {T.RIDGE} END AS r, "
        + ", ".join(f"sum(x) FILTER (y.{c} IS NOT NULL) * {0.5 if c in ('quality', 'toxic') else 1.0} + r AS {c}" for c in LABELS)
        + " FROM tx JOIN y USING (doc_id) GROUP BY j)",
        f"w0 AS (SELECT j, {_each('CAST(0 AS DOUBLE) AS {c}')} FROM ridge)", "v0 AS MATERIALIZED (FROM w0)",
    ]
    t = 1.0
    for k in range(rounds):
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        push, t = (t - 1) / t_next, t_next
        if k:
            ctes.append(f"v{k} AS MATERIALIZED (SELECT j, " + ", ".join(
                f"a.{c} + {push!r} * (a.{c} - b.{c}) AS {c}" for c in LABELS) + f" FROM w{k} a JOIN w{k - 1} b USING (j))")
        ctes += [
            f"z{k} AS (SELECT doc_id, {_each('sum(x * v.{c}) AS {c}')} FROM tx JOIN v{k} v USING (j) GROUP BY doc_id)",
            f"p{k} AS (SELECT doc_id, 1 / (1 + exp(-quality)) AS quality, 1 / (1 + exp(-toxic)) AS toxic, {_softmax()} FROM z{k})",
            f"e{k} AS MATERIALIZED (SELECT doc_id, {_each('coalesce(p.{c} - y.{c}, 0) AS {c}')} FROM p{k} p JOIN y USING (doc_id))",
            f"g{k} AS (SELECT j, {_each('sum(x * e.{c}) AS {c}')} FROM tx JOIN e{k} e USING (doc_id) GROUP BY j)",
            f"w{k + 1} AS MATERIALIZED (SELECT j, {_each('v.{c} - (g.{c} + r * v.{c}) / d.{c} AS {c}')} "
            f"FROM v{k} v JOIN g{k} g USING (j) JOIN ridge d USING (j))",
        ]
    ctes += [
        f"z AS (SELECT doc_id, {_each('sum(x * coalesce(w.{c}, 0)) AS {c}')} FROM x LEFT JOIN w{rounds} w USING (j) GROUP BY doc_id)",
        f"scored AS MATERIALIZED (SELECT doc_id, 1 / (1 + exp(-quality)) AS quality, 1 / (1 + exp(-toxic)) AS toxic, {_softmax()} FROM z)",
    ]
    return "WITH " + ",\n".join(ctes)


@register("trained_scores", f"{_fit_sql()}\nSELECT doc_id, {_each('ROUND({c}, 6) AS {c}')} FROM scored")
def trained_scores(spark, root):
    """M1/M2: every document scored by the heads fitted on the labelled documents that are not held out."""
    docs = read_table(spark, root, "documents", ["doc_id", "text"])
    return T.score(docs, _model(spark, root), keep=["doc_id"])


def _nll(target: str, p: str) -> str:
    p = f"least(greatest({p}, 1e-9), 1 - 1e-9)"
    return f"-avg({target} * ln({p}) + (1 - {target}) * ln(1 - {p}))"


@register("trained_report", f"""{_fit_sql()},
lex AS ({O.lexicon_sql("SELECT doc_id, text FROM documents")}),
held AS (SELECT l.doc_id, l.quality AS yq, l.toxic AS yt, lang, s.*, lex.anger, lex.positive / (lex.positive + lex.negative) AS pos
         FROM labels l JOIN documents d USING (doc_id) JOIN scored s USING (doc_id) JOIN lex USING (doc_id)
         WHERE md5(CAST(l.doc_id AS VARCHAR))[1:1] IN ({', '.join(repr(d) for d in HELD_OUT)})),
pri AS (SELECT avg(quality) AS quality, avg(toxic) AS toxic, {_each('avg({c}) AS {c}', LANGS)} FROM y)
SELECT 'quality' AS head, count(*) AS n, ROUND({_nll('yq', 'pri.quality')}, 6) AS prior, ROUND({_nll('yq', 'pos')}, 6) AS word_lists,
       ROUND({_nll('yq', 'held.quality')}, 6) AS trained FROM held, pri
UNION ALL SELECT 'toxic', count(*), ROUND({_nll('yt', 'pri.toxic')}, 6), ROUND({_nll('yt', 'held.anger')}, 6),
       ROUND({_nll('yt', 'held.toxic')}, 6) FROM held, pri
UNION ALL SELECT 'lang', count(*), ROUND(-avg(ln(CASE lang {' '.join(f"WHEN '{c}' THEN pri.{c}" for c in LANGS)} END)), 6), NULL,
       ROUND(-avg(ln(CASE lang {' '.join(f"WHEN '{c}' THEN held.{c}" for c in LANGS)} END)), 6) FROM held, pri""")
def trained_report(spark, root):
    """M1/M2/M6: cross-entropy on the held-out documents of the trained heads, of the word lists
    where they name the same thing, and of the training rows' mean as a constant prediction."""
    rows = _labelled(spark, root)
    prior = rows.filter(~_held_out()).agg(*[F.avg(c).alias(c) for c in LABELS]).first()  # one row
    scored = T.score(rows.filter(_held_out()).select(
        "doc_id", "text", *[F.col(c).alias(f"y_{c}") for c in LABELS]), _model(spark, root))
    held = lexicon_scores(scored).withColumn("pos", F.col("positive") / (F.col("positive") + F.col("negative")))

    def loss(names, multilabel, predicted):
        return T.log_loss(held, [f"y_{c}" for c in names], multilabel, predicted)

    rows = [("quality", ["quality"], "pos"), ("toxic", ["toxic"], "anger"), ("lang", list(LANGS), None)]
    one = held.agg(F.count(F.lit(1)).alias("n"), *[c.alias(f"{head}_{what}") for head, names, words in rows for what, c in (
        ("prior", loss(names, head != "lang", [F.lit(prior[c]) for c in names])),
        ("word_lists", loss(names, True, [words]) if words else F.lit(None).cast("double")),
        ("trained", loss(names, head != "lang", names)))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(head).alias("head"), "n", *[
        F.col(f"{head}_{what}").alias(what) for what in ("prior", "word_lists", "trained")]) for head, _, _ in rows])))
