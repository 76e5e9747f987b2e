"""The registered queries of the operators, each over its whole tables, and their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import (bpe, decontam, divergence, exact_dedup, fim, language, licences, pii, quality, sentence_spans, simhash,
               substring, token_store)
from .common import table


def op1_quality(spark, root):
    """Quality posterior and decision of every document."""
    return quality.assess(table(spark, root, "documents"), table(spark, root, "labels")).drop("text_key")


def op2_substring_dedup(spark, root):
    """Bytes that repeat an earlier 100-byte string, removed from every document."""
    return substring.remove_repeats(table(spark, root, "documents")).drop("kept")


def op3_byte_bpe(spark, root):
    """Byte-level BPE ids of every document, and the text they decode to."""
    return bpe.encode(table(spark, root, "documents")).drop("ids")


def op4_licence_scan(spark, root):
    """Licence of every document."""
    return licences.scan(table(spark, root, "documents"))


def op5_language_id(spark, root):
    """Language mixture of every document."""
    return language.identify(table(spark, root, "documents"))


def op6_sentence_dedup(spark, root):
    """Every document without the sentences of repeated runs."""
    return sentence_spans.remove_repeated_sentences(table(spark, root, "documents"))


def op7_simhash(spark, root):
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, root, "documents")).drop("text_key")


def op8_token_store(spark, root):
    """Place, number and checksum of every document's ids, read back from the shards."""
    return token_store.token_table(table(spark, root, "documents"), with_ids=False)


def op9_decontaminate(spark, root):
    """Benchmark windows that occur in every document."""
    return decontam.contamination(table(spark, root, "documents"), table(spark, root, "benchmark")).drop(
        "items", "text_key")


def op10_exact_dedup(spark, root):
    """Group of equal texts of every document."""
    return exact_dedup.exact_dedup(table(spark, root, "documents")).drop("text_key")


def op11_pii(spark, root):
    """Personal data in every document: base spans by kind, and all spans."""
    return pii.find(table(spark, root, "documents")).select(
        "doc_id", *[pii.count(k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.listed("s.base"), 256).alias("base_sha256"), pii.listed().alias("spans"))


def op12_fill_in_middle(spark, root):
    """Every document rearranged for fill-in-the-middle, and the text rebuilt from it."""
    return fim.transform(table(spark, root, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(), 256).alias("restored_sha256"))


def op13_source_divergence(spark, root):
    """Distances of the sources of each language, and the terms each uses more than its language."""
    return divergence.audit(table(spark, root, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_substring_dedup, op3_byte_bpe, op4_licence_scan, op5_language_id, op6_sentence_dedup, op7_simhash,
    op8_token_store, op9_decontaminate, op10_exact_dedup, op11_pii, op12_fill_in_middle,
    op13_source_divergence)}

ORACLE = {
    "op9_decontaminate": r"""
WITH d AS (SELECT doc_id, CAST(list_filter(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
             lambda x: x <> '') AS VARCHAR[]) AS w FROM documents),
b AS (SELECT item_id, CAST(list_filter(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
             lambda x: x <> '') AS VARCHAR[]) AS w FROM benchmark),
items AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
            FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT k FROM windows),
runs AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
         FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, k, item_id FROM runs JOIN windows USING (k, s)),
places AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
names AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items,
       sha256(coalesce(m.s, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places p USING (doc_id) LEFT JOIN names m USING (doc_id)
""",
    "op10_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(n) AS text_sha256
FROM t WINDOW same AS (PARTITION BY n)
""",
    "op12_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS w, CAST('0x' || h[1:8] AS BIGINT) AS h1,
             CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS i, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS j,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, form, CAST(len(w) AS BIGINT) AS n, array_to_string(w[1:i], '') AS a,
             array_to_string(w[i + 1:j], '') AS m, array_to_string(w[j + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m
              ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
""",
    "op13_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN v USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
size AS (SELECT lang, count(*) AS v FROM v GROUP BY 1),
p AS (SELECT g.lang, g.source, v.term, coalesce(n, 0) AS n,
             1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 5)) // (sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source) + 5 * size.v) AS p
      FROM g JOIN v USING (lang) JOIN size USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(size.v)) AS q
      FROM p JOIN size USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f
                    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s
           ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pair
          UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
best AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
                CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT * FROM best WHERE part = 'pair' OR rank <= 50
""",
}
