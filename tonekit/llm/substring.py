"""Repeated substrings by prefix-free parsing.

A rolling hash picks triggers in the bytes of a text: the trigger of a 100-byte string is its
k-byte piece of least hash (the leftmost of equals), so equal strings have equal triggers at
equal offsets, wherever they stand. Consecutive strings with one trigger form a phrase;
every 100-byte string lies in exactly one phrase, and phrases overlap by less than a string.

The parse of a text is its list of phrases, the dictionary the distinct phrases. Highly
repetitive text has a small dictionary: a phrase that stood in the corpus before needs no
further look, all its strings did too. Only where one trigger has several distinct phrases
can strings be shared between unlike phrases. The dictionary is dealt out by trigger, and the
suffix array of a trigger's phrases is built from their bytes, by prefix doubling up to 100
bytes; suffixes of equal rank agree in 100 bytes or more. The parse says where each phrase
stands first; with the places of its phrases a rank's suffixes come into corpus order, and
all but the first of them are repeats.
"""
from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_table, ints, keyed, later_copies, marked, real_id, settled, sized_batches

LENGTH = 100
#: Bytes of a trigger; LENGTH - TRIGGER + 1 of them compete in each string.
TRIGGER = 24
#: Bytes that are hashed at once; fits the cache. Longer texts are cut, with overlap.
PIECE = 1 << 18
#: Bytes of text whose phrases are compared before they are dealt out.
BATCH_BYTES = 8 << 20
_PLACE = np.uint64((1 << 22) - 1)


def _mix(x: np.ndarray, y: np.ndarray, level: int) -> np.ndarray:
    """Hash of two neighbouring hashes, another function for each level."""
    a = np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) & 0xFFFFFFFFFFFFFFFF)
    b = np.uint64(0xC2B2AE3D27D4EB4F * (2 * level + 3) & 0xFFFFFFFFFFFFFFFF)
    z = x * a
    z ^= z >> np.uint64(32)
    z += y * b
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xD6E8FEB86659FD93)
    z ^= z >> np.uint64(32)
    return z


def _hashes(raw: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``length``-byte and every ``k``-byte string of ``raw`` by doubling."""
    power = {1: raw.astype(np.uint64) + np.uint64(1)}

    def upto(n: int) -> np.ndarray:
        """Hash of every string of n bytes, from two overlapping strings of a power of two."""
        w = 1
        while 2 * w <= n:
            if 2 * w not in power:
                h = power[w]
                power[2 * w] = _mix(h[:-w], h[w:], w)
            w *= 2
        h = power[w]
        return h if w == n else _mix(h[:len(h) - (n - w)], h[n - w:], 1000 + n)

    return upto(length), upto(k)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return x if n == w else np.minimum(x[:len(x) - (w - n)], x[w - n:])


def _parse(raw: np.ndarray, ends: np.ndarray, length: int, k: int):
    """Phrases of texts that stand one after another in ``raw``: (trigger hash, phrase hash,
    first string, number of strings, text). Strings that cross the end of a text don't count."""
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if len(raw) < length:
        return none
    whole, small = _hashes(raw, length, k)
    packed = (small & ~_PLACE) | np.arange(len(small), dtype=np.uint64)
    least = _sliding_min(packed, length - k + 1)
    text = np.searchsorted(ends, np.arange(len(least)), side="right")
    ok = np.arange(len(least)) + length <= ends[np.minimum(text, len(ends) - 1)]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new & ok)
    if not len(first):
        return none
    stop = np.minimum.reduceat(np.where(ok, len(least), np.arange(len(least))), first)
    size = np.minimum(stop, np.append(first[1:], len(least))) - first
    trigger = small[(least[first] & _PLACE).astype(np.int64)]
    data, digest = raw.tobytes(), xxhash.xxh3_64_intdigest
    phrase = np.fromiter((digest(data[x:y]) for x, y in zip(first.tolist(), (first + size + length - 1).tolist())),
                         np.uint64, len(first))
    return trigger, phrase, first, size, text[first]


def suffix_ranks(raw: np.ndarray, length: int) -> np.ndarray:
    """Rank by content of every suffix of ``raw`` that has ``length`` bytes, compared up to ``length``: the
    suffix array, inverted, with one rank for suffixes whose common prefix is ``length`` or more.

    Prefix doubling: ranks by w bytes and those w places on give ranks by up to 2 w bytes."""
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    w = min(8, length)
    key = np.zeros(len(raw) - w + 1, np.uint64)
    for i in range(w):
        key = (key << np.uint64(8)) | raw[i:len(raw) - w + 1 + i]
    rank = np.unique(key, return_inverse=True)[1]
    while w < length:
        step = min(w, length - w)
        rank = np.unique(rank[:-step].astype(np.uint64) << np.uint64(32) | rank[step:].astype(np.uint64), return_inverse=True)[1]
        w += step
    return rank


def _pieces(texts: list[bytes], length: int):
    """Runs of (text, offset, bytes) of about PIECE bytes; long texts in overlapping pieces."""
    run, held = [], 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for at in range(0, max(1, len(t) - length + 1), PIECE):
            part = t[at:at + PIECE + length - 1]
            run.append((i, at, part))
            held += len(part)
            if held >= PIECE:
                yield run
                run, held = [], 0
    if run:
        yield run


def _first_of(*cols) -> tuple[np.ndarray, np.ndarray]:
    """Sort order of the columns (two keys, then the place) and whether a row starts a key."""
    order = np.lexsort(cols[::-1])
    a, b = cols[0][order], cols[1][order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def _joined(did, th, start, end):
    """Sorted intervals of the same row that touch or overlap as one."""
    o = np.lexsort((start, th, did))
    did, th, start, end = did[o], th[o], start[o], end[o]
    if not len(o):
        return did, th, start, end
    row = np.ones(len(o), bool)
    row[1:] = (did[1:] != did[:-1]) | (th[1:] != th[:-1])
    # ends grow within a row; an offset per row keeps rows apart in one running maximum
    shift = np.cumsum(row) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    new = row.copy()
    new[1:] |= start[1:] + shift[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(o)) - 1
    return did[at], th[at], start[at], reach[last] - shift[at]


#: Phrases of one trigger that a task compares at once; those of more frequent triggers are
#: taken apart into strings.
MANY = 4096
#: A phrase's place and number of strings share one integer.
_SIZE = 10
#: A row is a phrase (p: place and size), or an interval known to repeat (p: -1 - start, r: end).
_PHRASES = "a long, r long, did long, th long, p long"
_STRINGS = "a long, b long, did long, th long, p long, q long, data binary"


def _batch(cols: dict, known: tuple, end: str) -> pa.RecordBatch:
    """Rows ``cols`` and known intervals; those have their end in column ``end`` and a spread key."""
    did, th, start, stop = known
    zero = np.zeros(len(did), np.int64)
    more = {"a": did * 31 + start, "did": did, "th": th, "p": -1 - start, end: stop}
    out = {k: pa.array(np.concatenate([v, more.get(k, zero)])) if k != "data" else
           pa.array(v + [b""] * len(did), pa.binary()) for k, v in cols.items()}
    return pa.RecordBatch.from_pydict(out)


def _repeats(order, new, did, th, pos):
    """Of sorted rows, those that are neither the first of their key nor stand at its place."""
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    same = (did[order] == did[head]) & (th[order] == th[head]) & (pos[order] == pos[head])
    return order[~new & ~same]


def phrases(docs: DataFrame, length: int = LENGTH, k: int = TRIGGER) -> DataFrame:
    """The parse of every text, without phrases that the same batch has earlier; those come as
    ``known`` intervals, joined, so a passage in every text is one row a batch."""
    def run(batches):
        for b in sized_batches(batches, BATCH_BYTES):
            did, th = ints(b, "did"), ints(b, "th")
            texts = [t.as_py().encode("utf-8", "surrogatepass") for t in b.column("text")]
            got = []
            for piece in _pieces(texts, length):
                raw = np.frombuffer(b"".join(p for _, _, p in piece), np.uint8)
                ends = np.cumsum([len(p) for _, _, p in piece])
                a, r, first, n, at = _parse(raw, ends, length, k)
                begin = ends - [len(p) for _, _, p in piece]
                row, off = (np.array([p[j] for p in piece], np.int64) for j in (0, 1))
                got.append((a, r, row[at], first - begin[at] + off[at], n))
            if not got:
                continue
            a, r, row, pos, n = (np.concatenate(x) for x in zip(*got))
            a, r = a.view(np.int64), r.view(np.int64)
            did, th = did[row], th[row]
            order, new = _first_of(a, r, did, th, pos)
            keep, rest = order[new], _repeats(order, new, did, th, pos)
            known = _joined(did[rest], th[rest], pos[rest], pos[rest] + n[rest] + length - 1)
            yield _batch({"a": a[keep], "r": r[keep], "did": did[keep], "th": th[keep], "p": (pos[keep] << _SIZE) + n[keep]},
                         known, "r")

    return docs.mapInArrow(run, _PHRASES)


def _judge(rows: DataFrame, length: int) -> DataFrame:
    """Of the phrases of each trigger, in corpus order: known intervals where the phrase stood
    before; else the distinct phrases of triggers that have several. The rest need no look.

    The pass over the sorted rows remembers one phrase: the first of the trigger, until a
    second distinct one shows that both are needed.
    """
    names = ["a", "r", "did", "th", "p"]

    def scan(batches):
        last = pending = None  # last: first row (a, r, did, th, p) of the phrase; pending: a held row
        for batch in batches:
            if batch.num_rows == 0:
                continue
            v = {n: ints(batch, n) for n in names}
            out = [{n: x[v["p"] < 0] for n, x in v.items()}]
            v = {n: x[v["p"] >= 0] for n, x in v.items()}
            m = len(v["p"])
            if m:
                new_a, new_r = np.ones(m, bool), np.ones(m, bool)
                new_a[1:] = v["a"][1:] != v["a"][:-1]
                new_r[1:] = new_a[1:] | (v["r"][1:] != v["r"][:-1])
                if last is not None:
                    new_a[0] = v["a"][0] != last["a"]
                    new_r[0] = new_a[0] or v["r"][0] != last["r"]
                head = np.maximum.accumulate(np.where(new_r, np.arange(m), -1))
                again = np.zeros(m, bool)
                for n in ("did", "th", "p"):
                    again |= v[n] != np.where(head >= 0, v[n][np.maximum(head, 0)], last[n] if last else 0)
                again &= ~new_r
                # a distinct phrase after the first of its trigger: it and the first are needed
                part = np.cumsum(new_a)
                several = np.zeros(m + 1, bool)
                several[part[new_r & ~new_a]] = True
                need = new_r & several[part]
                if pending is not None and several[0]:
                    out.append(pending)
                if new_a.any() or several[0]:
                    pending = None
                starts = np.flatnonzero(new_a)
                if len(starts) and not several[part[starts[-1]]]:
                    pending = {n: x[starts[-1]:starts[-1] + 1] for n, x in v.items()}
                if head[-1] >= 0:
                    last = {n: x[head[-1]] for n, x in v.items()}
                pos, size = v["p"][again] >> _SIZE, v["p"][again] & ((1 << _SIZE) - 1)
                out.append({"a": v["a"][again], "r": pos + size + length - 1, "did": v["did"][again], "th": v["th"][again],
                            "p": -1 - pos})
                out.append({n: x[need] for n, x in v.items()})
            yield pa.RecordBatch.from_pydict({n: np.concatenate([o[n] for o in out]) for n in names})

    return rows.repartition("a").sortWithinPartitions(*names).mapInArrow(scan, _PHRASES)


def _expanded(need: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The needed phrases with their bytes. Those of a trigger with over MANY phrases come as
    single strings instead, keyed by the string's hash (b: the trigger), and of equal strings in
    a batch the first, the others as known intervals: no trigger and no string gathers rows."""
    many = settled(need.groupBy("a").count().filter(F.col("count") > MANY).select("a", F.lit(True).alias("many")), "many")
    per_text = settled(need.join(many, "a", "left").groupBy("did", "th").agg(
        F.collect_list(F.struct("a", "p", F.coalesce("many", F.lit(False)).alias("many"))).alias("ph")), "needed")
    where = marked(docs, bit_table(per_text, ["did", "th"]), ["did", "th"]).filter("_maybe")

    def run(batches):
        for batch in sized_batches(batches, BATCH_BYTES):
            did, th = ints(batch, "did"), ints(batch, "th")
            rows = {n: [] for n in ("a", "did", "th", "p")}
            data, strings = [], []
            for i in range(batch.num_rows):
                raw = batch.column("text")[i].as_py().encode("utf-8", "surrogatepass")
                ph = batch.column("ph")[i].values
                a, p, apart = (ph.field(j).to_numpy(zero_copy_only=False) for j in range(3))
                apart = apart.astype(bool)
                pos, n = p >> _SIZE, p & ((1 << _SIZE) - 1)
                data += [raw[x:x + k + length - 1] for x, k in zip(pos[~apart].tolist(), n[~apart].tolist())]
                for name, x in (("a", a[~apart]), ("p", p[~apart]), ("did", np.full((~apart).sum(), did[i])),
                                ("th", np.full((~apart).sum(), th[i]))):
                    rows[name].append(x)
                for x, k, t in zip(pos[apart].tolist(), n[apart].tolist(), a[apart].tolist()):
                    w, _ = _hashes(np.frombuffer(raw, np.uint8, k + length - 1, x), length, 1)
                    strings.append((w.view(np.int64), np.full(k, t), np.full(k, i), x + np.arange(k)))
            cool = {n: np.concatenate(x) if x else np.zeros(0, np.int64) for n, x in rows.items()}
            w, t, row, pos = (np.concatenate(x) for x in zip(*strings)) if strings else [np.zeros(0, np.int64)] * 4
            wd, wt = did[row], th[row]
            order, new = _first_of(w, t, wd, wt, pos)
            keep, rest = order[new], _repeats(order, new, wd, wt, pos)
            yield _batch({"a": np.concatenate([cool["a"], w[keep]]), "b": np.concatenate([cool["a"], t[keep]]),
                          "did": np.concatenate([cool["did"], wd[keep]]), "th": np.concatenate([cool["th"], wt[keep]]),
                          "p": np.concatenate([cool["p"], pos[keep]]), "q": np.zeros(len(data) + len(keep), np.int64),
                          "data": data + [b""] * len(keep)},
                         _joined(wd[rest], wt[rest], pos[rest], pos[rest] + length), "q")

    return where.join(per_text, ["did", "th"]).select("did", "th", "text", "ph").mapInArrow(run, _STRINGS)


def _shared_strings(rows: DataFrame, length: int) -> DataFrame:
    """(did, th, start, end): strings of the phrases of one trigger that an earlier phrase has.

    The suffixes of the triggers' phrases are ranked by their bytes; of those with one rank all
    but the first in corpus order are repeats. Whole triggers are taken, as many as a batch has.
    """
    def run(batches):
        held = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
                held = t.to_batches()[0] if t.num_rows else None
            if held is None:
                continue
            a = ints(held, "a")
            new = np.append(True, a[1:] != a[:-1])
            cut = held.num_rows if b is None else int(np.flatnonzero(new)[-1])  # the last one may go on
            if cut:
                part = held.slice(0, cut)
                did, th, p = (ints(part, n) for n in ("did", "th", "p"))
                pos, n = p >> _SIZE, p & ((1 << _SIZE) - 1)
                rank = suffix_ranks(np.frombuffer(b"".join(part.column("data").to_pylist()), np.uint8), length)
                row = np.repeat(np.arange(cut), n)
                off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                begin = np.cumsum(n + length - 1) - (n + length - 1)
                order, first = _first_of(np.cumsum(new[:cut])[row], rank[begin[row] + off], row, off, off)
                gone = np.zeros(len(row), bool)
                gone[_repeats(order, first, did[row], th[row], pos[row] + off)] = True
                edge = gone & ~np.append(False, gone[:-1] & (row[1:] == row[:-1]))
                last = gone & ~np.append(gone[1:] & (row[1:] == row[:-1]), False)
                s = np.flatnonzero(edge)
                yield pa.RecordBatch.from_pydict({
                    "did": did[row[s]], "th": th[row[s]], "start": pos[row[s]] + off[s],
                    "end": pos[row[s]] + off[np.flatnonzero(last)] + length})
            held = held.slice(cut) if cut < held.num_rows else None

    return rows.select("a", "did", "th", "p", "data").repartition("a").sortWithinPartitions("a", "did", "th", "p").mapInArrow(
        run, "did long, th long, start long, end long")


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = TRIGGER) -> DataFrame:
    """(did, th, start, end): stretches of bytes covered by strings of ``length`` bytes that start
    earlier too, for ``docs`` (did, th, text). Stretches of a row may overlap."""
    judged = settled(_judge(phrases(docs, length, k), length), "phrases")
    rows = settled(_expanded(judged.filter("p >= 0").select("a", "did", "th", "p"), docs, length), "strings")
    strings = rows.filter("p >= 0 and length(data) = 0").select("a", "b", "did", "th", "p")
    later = later_copies(strings, ["a", "b"], ["did", "th", "p"])
    start = (-1 - F.col("p")).alias("start")
    return (judged.filter("p < 0").select("did", "th", start, F.col("r").alias("end"))
            .unionByName(rows.filter("p < 0").select("did", "th", start, F.col("q").alias("end")))
            .unionByName(_shared_strings(rows.filter("length(data) > 0"), length))
            .unionByName(later.select("did", "th", F.col("p").alias("start"), (F.col("p") + length).alias("end"))))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes).

    A byte goes if a ``length``-byte string that covers it also starts earlier: in a document of
    smaller id, or before in the same one (strings are those of the input, overlaps count).
    Null texts count as empty; shorter texts lose nothing. Null ids come first, equal ids are
    ordered by text hash, and rows with equal id and text count as one place in the corpus, so
    each gets the same result. Other columns are not read. Long texts are parsed in pieces. An
    empty table gives no rows.
    """
    rows = keyed(docs, id_col, text_col)
    spans = settled(repeated_spans(rows, length), "spans")
    per_text = spans.groupBy("did", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def run(batches):
        for b in sized_batches(batches, BATCH_BYTES):
            out = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for i in range(b.num_rows):
                raw = b.column("text")[i].as_py().encode("utf-8", "surrogatepass")
                spans = b.column("spans")[i].values
                parts, removed, runs = [raw], 0, 0
                if spans is not None and len(spans):
                    s, e = (spans.field(j).to_numpy(zero_copy_only=False) for j in range(2))
                    zero = np.zeros(len(s), np.int64)
                    _, _, s, e = _joined(zero, zero, s, e)
                    cuts = list(itertools.chain([0], *zip(s.tolist(), e.tolist()), [len(raw)]))
                    parts = [raw[x:y] for x, y in zip(cuts[::2], cuts[1::2])]
                    removed, runs = int((e - s).sum()), len(s)
                kept = b"".join(parts)
                for n, v in zip(out, (len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept)):
                    out[n].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column("did"), *[pa.array(v, t) for v, t in zip(out.values(), kinds)]], ["doc_id", *out])

    # texts without a repeat are told apart by the bit table and never shuffled
    parted = marked(rows, bit_table(spans, ["did", "th"]), ["did", "th"])
    none = F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans")
    whole = (parted.filter("_maybe").join(per_text, ["did", "th"], "left").select("did", "text", "spans")
             .unionByName(parted.filter("not _maybe").select("did", "text", none)))
    out = whole.mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumn("doc_id", real_id("doc_id"))


def brute_force(docs: list[tuple], length: int = LENGTH) -> list[tuple]:
    """The same digest for small inputs, string by string."""
    seen, out = set(), []
    for d, text in sorted(docs, key=lambda x: x[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            s = raw[i:i + length]
            if s in seen:
                gone[i:i + length] = True
            seen.add(s)
        edge = np.diff(np.concatenate(([0], gone.astype(np.int8))))
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        out.append((d, len(raw), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
