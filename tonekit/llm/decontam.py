"""Benchmark decontamination over a distributed positional inverted index.

The index is cut by document: a shard holds some documents' postings, term by term, with
positions. Queries go to every shard; a shard starts from the query's rarest term and
intersects the other terms' positions, shifted by their offset, from rare to common. No
posting is ever shuffled, and a term that every document has costs each shard its own part.
"""
from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ints, keyed, real_id, settled, sized_batches

WINDOW = 10
#: Bytes of text in a shard, but one document at least.
SHARD_BYTES = 2 << 20
#: Bytes of query text that one search sends to the shards; more is searched in blocks.
BLOCK_BYTES = 8 << 20

_INDEX = ("shard string, dids binary, ths binary, counts binary, words binary, "
          "ends binary, positions binary")


def _fold_table() -> bytes:
    """Bytes of words stay (A-Z lower-cased, digits, a-z, all from 0x80); others become blanks."""
    keep = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in keep else 0x20 for b in range(256))


_FOLD = _fold_table()


def words_of(text: str) -> list[bytes]:
    """Words of a text: runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _starts(counts: np.ndarray, gap: int) -> np.ndarray:
    """Position of each document's first word; between documents ``gap`` positions stay empty."""
    return np.cumsum(counts + gap) - counts


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per shard: its documents, its words and each word's ascending positions.

    Positions number the shard's words from 0; they are stored as differences.
    """
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for i, b in enumerate(sized_batches(batches, SHARD_BYTES)):
            index: dict[bytes, int] = {}
            codes, counts = [], []
            for t in b.column("text"):
                words = words_of(t.as_py())
                counts.append(len(words))
                codes.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words)))
            code = np.concatenate(codes)
            at = np.argsort(code, kind="stable").astype(np.int32)
            ends = np.cumsum(np.bincount(code, minlength=len(index)), dtype=np.int64)
            yield pa.RecordBatch.from_pydict({
                "shard": [f"{part}-{i}"], "dids": [ints(b, "did").astype("<i8").tobytes()],
                "ths": [ints(b, "th").astype("<i8").tobytes()], "counts": [np.array(counts, "<i8").tobytes()],
                "words": [b" ".join(index)], "ends": [ends.astype("<i8").tobytes()],
                "positions": [np.diff(at, prepend=np.int32(0)).astype("<i4").tobytes()]})

    return keyed(docs, id_col, text_col).mapInArrow(run, _INDEX)


def _windows(items: list[tuple[str | None, str]], n: int):
    """(words, item of each window, its length, its words' codes): every run of n words of each
    item, or the whole item where it is shorter; equal windows of an item count once."""
    index: dict[bytes, int] = {}
    rows: dict[tuple, None] = {}
    for i, (_, text) in enumerate(items):
        code = [index.setdefault(w, len(index)) for w in words_of(text)]
        for s in range(max(1, len(code) - n + 1) if code else 0):
            rows[i, tuple(code[s:s + n])] = None
    size = np.array([len(w) for _, w in rows], np.int64)
    codes = np.full((len(rows), n), -1, np.int64)
    for r, (_, w) in enumerate(rows):
        codes[r, :len(w)] = w
    return list(index), np.array([i for i, _ in rows], np.int64), size, codes


def _search(keys, span, first, freq, size, codes, slop):
    """(window, position) of every match: the window's words at their offsets, each up to
    ``slop`` positions off.

    ``keys`` is term * span + position of all postings in order; ``first`` and ``freq`` give
    each query word's term and frequency here.
    """
    n = codes.shape[1]
    f = np.where(codes >= 0, freq[codes], np.iinfo(np.int64).max)
    alive = np.flatnonzero(f.min(axis=1, initial=np.iinfo(np.int64).max) > 0)
    order = np.argsort(f[alive], axis=1, kind="stable")  # offsets from the rarest term on
    term = first[codes[alive]]
    rows = np.arange(len(alive))
    count = f[alive, order[:, 0]] if len(alive) else np.zeros(0, np.int64)
    win = np.repeat(rows, count)
    lead = order[:, 0]
    begin = np.searchsorted(keys, term[rows, lead] * span)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    pos = keys[begin[win] + inside] - term[win, lead[win]] * span - lead[win]
    for k in range(1, n):
        on = size[alive[win]] > k
        off = order[win, k]
        base = term[win, off] * span
        want = base + pos + off
        at = np.searchsorted(keys, np.maximum(want - slop, base))
        ok = ~on | ((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] <= want + slop))
        win, pos = win[ok], pos[ok]
    return alive[win], pos


def search(index: DataFrame, items: list[tuple[str | None, str]], n: int = WINDOW, slop: int = 0) -> DataFrame:
    """One row per indexed document: its place, ids, number of words, the positions that matches
    cover (starts and ends of runs, ends excluded) and the ids of the matching items."""
    words, item, size, codes = _windows(items, n)
    names = [i for i, _ in items]
    gap = n + 2 * slop + 1

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                dids, ths, counts = (np.frombuffer(row[c], "<i8") for c in ("dids", "ths", "counts"))
                ends = np.frombuffer(row["ends"], "<i8")
                starts, held = _starts(counts, gap), np.cumsum(counts) - counts
                here = {w: t for t, w in enumerate(row["words"].split())}
                first = np.array([here.get(w, -1) for w in words], np.int64)
                freq = np.where(first >= 0, (ends - np.concatenate(([0], ends[:-1])))[first], 0) \
                    if len(ends) else np.zeros(len(words), np.int64)
                # only postings of the query's terms are unpacked into one ordered list
                total = int(starts[-1] + counts[-1] + gap)
                shift = np.repeat(starts - held, counts)
                at = np.cumsum(np.frombuffer(row["positions"], "<i4"), dtype=np.int64)
                term = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                asked = np.zeros(len(ends), bool)
                asked[first[first >= 0]] = True
                pick = asked[term] if len(ends) else np.zeros(0, bool)
                keys = term[pick] * total + at[pick] + shift[at[pick]]
                win, pos = _search(keys, total, first, freq, size, codes, slop) if len(keys) and len(size) else (
                    np.zeros(0, np.int64), np.zeros(0, np.int64))
                doc = np.searchsorted(starts, pos + slop, side="right") - 1
                lo = np.maximum(pos - slop, starts[doc]) - starts[doc]
                hi = np.minimum(pos + size[win] + slop, starts[doc] + counts[doc]) - starts[doc] if slop else \
                    pos + size[win] - starts[doc]
                runs = [[] for _ in dids]
                found = [set() for _ in dids]
                for d, a, b, w in sorted(zip(doc.tolist(), lo.tolist(), hi.tolist(), win.tolist())):
                    r = runs[d]
                    if r and a <= r[-1][1]:
                        r[-1][1] = max(r[-1][1], b)
                    else:
                        r.append([a, b])
                    found[d].add(int(item[w]))
                yield pa.RecordBatch.from_pydict({
                    "shard": [row["shard"]] * len(dids), "ordinal": np.arange(len(dids)), "did": dids, "th": ths,
                    "n_words": counts, "runs": pa.array(runs, pa.list_(pa.list_(pa.int64()))),
                    "items": pa.array([sorted({names[i] for i in s if names[i] is not None}) for s in found],
                                      pa.list_(pa.string()))})

    return index.mapInArrow(run, "shard string, ordinal long, did long, th long, n_words long, "
                                 "runs array<array<long>>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, slop: int = 0, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, text_key.

    ``slop`` 0 finds exact phrases; above it, each word may stand that many positions off
    (proximity). Null texts have no words; items without words match nothing; an item with a
    null id marks words but is not listed; item ids that repeat are listed once. Documents
    that repeat are judged row by row. Without documents there are no rows, without items no hits.

    The benchmark is read in blocks of about BLOCK_BYTES, however large it is; the index is
    built once and each block is searched over all of it.
    """
    index = settled(build_index(docs, id_col, text_col), "index")
    asked = settled(benchmark.select(F.col(item_col).cast("string").alias("i"), F.coalesce(F.col(item_text), F.lit(""))
                                     .alias("t")), "items")
    total = asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    part = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    found = None
    for b in range(blocks):
        items = [(r.i, r.t) for r in asked.filter(part == b).distinct().toLocalIterator()]
        one = search(index, items, n, slop)
        found = one if found is None else found.unionByName(one)
    if blocks > 1:
        found = found.groupBy("shard", "ordinal").agg(
            F.first("did").alias("did"), F.first("th").alias("th"), F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("runs")).alias("runs"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        hit = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r[0], r[1] - 1)))))
    else:
        hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r[1] - r[0])
    return found.select(
        real_id().alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"), "items", F.col("th").alias("text_key"))


def brute_force(docs: list[tuple], items: list[tuple], n: int = WINDOW) -> list[tuple]:
    """The same digest for small inputs, window by window."""
    out = []
    windows = {}
    for i, text in items:
        w = words_of(text or "")
        for s in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[s:s + n]), set()).add(i)
    for d, text in docs:
        w, hit, found = words_of(text or ""), set(), set()
        for s, k in itertools.product(range(len(w)), range(1, n + 1)):
            if s + k <= len(w) and (got := windows.get(tuple(w[s:s + k]))):
                hit.update(range(s, s + k))
                found |= got
        ids = sorted({str(i) for i in found if i is not None})
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out
