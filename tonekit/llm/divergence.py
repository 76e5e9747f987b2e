"""Divergence audit of sources: how far the word use of each source of a language is from the others'.

Rows are the groups (lang, source), columns the kept terms of the language, entries counts; a
group's smoothed share of a term is p = 1 + floor(1e9 (count + 5) / (N + 5 V)), N its occurrences
of kept terms, V their number. The distance of two groups is the sum of |p - p'| over all kept
terms, which most pairs of groups share few of.

Gustavson's row accumulation: the counts are turned into a term-major index (term -> postings of
groups). Within a block of terms, each group takes its terms in turn, scatters their postings into
a dense accumulator with one place per peer, and gives out the accumulator. No pair of postings is
ever a row. A group without a term has the baseline z = 1 + floor(5e9 / (N + 5 V)) there, not zero,
so sums over common terms alone are wrong; they are corrected by

    sum |p - p'| = V |z - z'| + S(g, g') + S(g', g) + X(g, g')
    S(g, g')     = sum over the terms of g of |p - z'| - |z - z'|
    X(g, g')     = sum over the common terms of |p - p'| - |p - z'| - |z - p'| + |z - z'|

S needs no postings: the shares of g, sorted, and their running sums give it for all peers at once.
Everything is an integer, and exact.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, settled, sized_batches

#: Documents of a language that a kept term is in, at least.
MIN_DOCS = 30
TOP_TERMS = 50
UNIT, ADD = 1_000_000_000, 5

BATCH_BYTES = 1 << 20
#: Bytes of one text that are cut into terms at once.
PIECE = 1 << 20
#: Counters that a counting task holds before it gives them out, whatever the number of groups, and rows it gives out at once.
HELD = 300_000
GIVEN = 20_000
#: Postings of a block of the index, about (a block is one task's share; its terms are whole).
BLOCK = 250_000
#: Pairs of groups that one task gives out, about.
PAIRS = 2_000_000
#: Postings that a group's row scatters in one step, about.
STEP = 1 << 20

#: Bytes of a UTF-8 text: letters to lower case, other ASCII to blanks, the rest (parts of characters beyond ASCII) as is.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: bytes):
    """Lists of the terms of a UTF-8 text: runs of letters A-Z, lower-cased, and characters beyond ASCII."""
    a = 0
    while a < len(text):
        part = text[a:a + PIECE].translate(FOLD)
        cut = len(part)
        if a + cut < len(text):  # back to the last blank; forward, if a single term fills the piece
            cut = part.rfind(b" ") + 1
            while not cut:
                more = text[a + len(part):a + 2 * len(part)].translate(FOLD)
                cut = len(part) + more.find(b" ") + 1 if b" " in more else 0
                part += more
                if not more:
                    cut = len(part)
        yield part[:cut].split()
        a += cut


def occurrences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, d): partial sums by group of the occurrences of each term and of the rows that have it.

    A task adds up over its rows, so a group with a third of all rows is one row per term and task.
    """
    rows = bounded_batches(docs).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in (
        (lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def run(batches):
        held, size = {}, 0
        for b in sized_batches(batches, BATCH_BYTES):
            texts = b.column("text").cast(pa.binary())
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), texts):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for terms in terms_of(text.as_py()):
                    n.update(terms)
                    seen.update(terms)
                d.update(seen)
                size += len(n) - before
                if size > HELD:
                    yield from _sums(held)
                    held, size = {}, 0
        yield from _sums(held)

    return rows.mapInArrow(run, "lang string, source string, term string, n long, d long")


def _sums(held):
    for (lang, source), (n, d) in held.items():
        terms = list(n)
        for a in range(0, len(terms), GIVEN):
            part = terms[a:a + GIVEN]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.repeat(lang, len(part)), "source": pa.repeat(source, len(part)),
                "term": pa.array(part, pa.binary()).cast(pa.string()),
                "n": pa.array([n[t] for t in part], pa.int64()), "d": pa.array([d[t] for t in part], pa.int64())})


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT (n + ADD) / (total + ADD terms)) in whole numbers of up to 38 digits; null without terms."""
    wide = "cast({} as decimal(20,0))".format
    return F.expr(f"case when {terms} > 0 then 1 + (cast({UNIT} as decimal(10,0)) * ({wide(n)} + {ADD}))"
                  f" div ({wide(total)} + {ADD} * {wide(terms)}) end")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, **columns) -> DataFrame:
    """(lang, term, n, cells): the terms that at least ``min_docs`` documents of the language have, with
    their occurrences in all and by source. The tasks' sums are unique within a task and are dealt out
    by group and term before they are added up, so neither a hot group nor a frequent term is one key."""
    sums = occurrences(docs, **columns).repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("d").alias("d"))
    return settled(sums.groupBy("lang", "term").agg(
        F.sum("d").alias("d"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("cells"))
        .filter(F.col("d") >= min_docs).drop("d"), "terms")


def groups_of(docs: DataFrame, kept: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, g, total, all, terms, z, blocks, parts) of every group that occurs: its number by source
    within the language, N of the group and of the language, V, the baseline, and how the work is dealt."""
    here = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in (
        (lang_col, "lang"), (source_col, "source"))]).distinct()
    total = kept.select("lang", F.inline("cells")).groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.count("*").alias("cells"))
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    lang = Window.partitionBy("lang")
    g = (here.join(total, ["lang", "source"], "left").join(by_lang, "lang", "left")
         .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"),
                 F.coalesce("cells", F.lit(0)).alias("cells"), F.coalesce("terms", F.lit(0)).alias("terms"))
         .withColumn("g", (F.row_number().over(lang.orderBy("source")) - 1).cast("int"))
         .withColumn("all", F.sum("total").over(lang)).withColumn("peers", F.count("*").over(lang))
         .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.sum("cells").over(lang) / BLOCK)).cast("int"))
         .withColumn("parts", F.ceil(F.col("peers") * F.col("peers") / PAIRS).cast("int")))
    return settled(g.select("lang", "source", "g", "total", "all", "terms", "blocks", "parts",
                            F.coalesce(share("0", "total", "terms"), F.lit(0)).alias("z")), "groups")


def term_index(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """The term-major index: (lang, term, block, parts, q, postings), postings (g, p) by g, q the language's share."""
    cells = kept.select("lang", "term", F.inline("cells")).join(groups, ["lang", "source"]).withColumn(
        "p", share("n", "total", "terms"))
    each = cells.groupBy("lang", "term").agg(
        F.sort_array(F.collect_list(F.struct("g", "p"))).alias("postings"), F.sum("n").alias("n"),
        *[F.max(c).alias(c) for c in ("all", "terms", "blocks", "parts")])
    return settled(each.select(
        "lang", "term", F.expr("cast(pmod(xxhash64(term), blocks) as int)").alias("block"), "parts",
        share("n", "`all`", "terms").alias("q"), "postings"), "index")


def accumulate(z: np.ndarray, terms: int, first: bool, rows: range, ends: np.ndarray, g: np.ndarray, p: np.ndarray):
    """(a, b, v) arrays, a < b, of the given rows over a block of the index: its postings (g, p) term by
    term, ``ends`` the place after the last posting of each posting's term. The first block adds the baseline."""
    order = np.argsort(g, kind="stable")
    bounds = np.searchsorted(g[order], np.arange(len(z) + 1))
    peers = np.arange(len(z))
    for r in rows:
        own = order[bounds[r]:bounds[r + 1]]
        acc = np.zeros(len(z), np.int64)
        if len(own):
            mine, apart = p[own], np.abs(z - z[r])
            ranked = np.sort(mine)
            run = np.concatenate([[0], np.cumsum(ranked)])
            below = np.searchsorted(ranked, z)  # shares under each peer's baseline
            acc += run[-1] - 2 * run[below] + z * (2 * below - len(own)) - len(own) * apart
            after = ends[own] - own - 1  # postings of later groups under each term
            step = np.cumsum(after) // STEP
            for cut in np.split(np.arange(len(own)), np.flatnonzero(np.diff(step)) + 1):
                many = after[cut]
                at = np.repeat(own[cut] + 1 - np.cumsum(many) + many, many) + np.arange(many.sum())
                h, theirs, ours = g[at], p[at], np.repeat(mine[cut], many)
                np.add.at(acc, h, np.abs(ours - theirs) - np.abs(ours - z[h]) - np.abs(z[r] - theirs) + apart[h])
        if first:
            acc[r + 1:] += terms * np.abs(z[r + 1:] - z[r])
        out = (peers != r) & ((acc != 0) | (first & (peers > r)))
        yield np.minimum(peers, r)[out], np.maximum(peers, r)[out], acc[out]


def distances(groups: DataFrame, index: DataFrame) -> DataFrame:
    """(lang, a, b, value), a < b: distance of any two groups of a language, by their numbers.

    A task holds one block of terms and one part of the rows, at most about BLOCK postings and PAIRS results.
    """
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    left = index.select("lang", "block", part, "postings")
    right = groups.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select(
        "lang", "block", part, "parts", "g", "z", "terms")

    def run(key, left, right):
        if not right.num_rows:
            return _pairs("", [])
        lang, block, part = (k.as_py() for k in key)
        z = np.zeros(right.num_rows, np.int64)
        z[right["g"].to_numpy()] = right["z"].to_numpy()
        parts, terms = right["parts"][0].as_py(), right["terms"][0].as_py()
        lists = left["postings"].combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], left.schema.field("postings").type)
        flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
        ends = np.repeat(np.cumsum(sizes), sizes)
        g, p = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("g", "p"))
        rows = range(part * len(z) // parts, (part + 1) * len(z) // parts)
        return _pairs(lang, list(accumulate(z, terms, block == 0, rows, ends, g.astype(np.int64), p.astype(np.int64))))

    each = left.groupBy("lang", "block", "part").cogroup(right.groupBy("lang", "block", "part")).applyInArrow(
        run, "lang string, a int, b int, value long")
    return each.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _pairs(lang: str, rows) -> pa.Table:
    a, b, v = (np.concatenate(x) if rows else np.zeros(0, np.int64) for x in (zip(*rows) if rows else ((), (), ())))
    return pa.table({"lang": pa.array([lang], pa.string()).take(pa.array(np.zeros(len(a), np.int64))),
                     "a": a.astype(np.int32), "b": b.astype(np.int32), "value": v.astype(np.int64)})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, text_col: str = "text",
          lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) of every group.

    Part ``pair``: the distance to each other source of the language, all ranks. Part ``term``: the
    ``top`` terms whose share in the group exceeds the language's by most. Ranks go by value
    descending, then item by its UTF-8 bytes.

    Null text, lang and source count as ''. Rows count one by one, so a repeated row counts
    twice; a group without terms has pairs and no terms; a language without kept terms has
    distances of 0; a lone source has no pairs. Only the three columns are read. An empty
    table gives no rows. A text of any length is read in pieces cut between terms.
    """
    columns = {"text_col": text_col, "lang_col": lang_col, "source_col": source_col}
    kept = kept_terms(docs, min_docs, **columns)
    groups = groups_of(docs, kept, lang_col, source_col)
    index = term_index(kept, groups)
    names = groups.select("lang", "g", "source")
    both = settled(distances(groups, index), "distances").select(
        "lang", "value", F.explode(F.expr("array(struct(a as g, b as h), struct(b as g, a as h))")).alias("e"))
    pair = both.select("lang", "e.*", "value").join(names, ["lang", "g"]).join(
        names.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    over = index.select("lang", "term", "q", F.explode("postings").alias("e")).filter("e.p > q").select(
        "lang", F.col("e.g").alias("g"), F.col("term").alias("item"), (F.col("e.p") - F.col("q")).alias("value"))

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        best = Window.partitionBy("lang", "g").orderBy(F.desc("value"), "item")
        return rows.select("lang", "g", F.lit(part).alias("part"), "item", "value", F.row_number().over(best).alias("rank"))

    term = ranked(over, "term").filter(F.col("rank") <= top).join(names, ["lang", "g"])
    pair = ranked(pair, "pair").join(names, ["lang", "g"])
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return pair.select(*cols).unionByName(term.select(*cols))
