"""Repeated runs of consecutive sentences: hash each, join globally, remove what is covered.

From every sentence the shortest run is hashed that has at least SENTENCES sentences and
WORDS words, so single words and short stock phrases never make a repeat. Every run but the
first of its kind in the corpus marks its sentences. In scripts without blanks (Chinese,
Japanese, Thai and others) each character counts as a word.
"""
from __future__ import annotations

import itertools
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ints, keyed, later_copies, real_id, settled, sized_batches

SENTENCES = 3
WORDS = 16
#: A sentence of more words is cut by its words, or a text without stops is one sentence.
LONGEST = 16
#: Of so many consecutive words of a long sentence, at least one ends a piece.
WINDOW = 8
BATCH_BYTES = 8 << 20
REMEMBER = 200_000
#: Scripts written without blanks: Thai to Tibetan, Myanmar, Khmer, kana, bopomofo, Han.
_WIDE = ("\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf"
         "\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff")
#: The wide stops end a sentence without white space after them; closing marks go with them.
_STOP = re.compile(r"(?<=[.!?。！？｡])\s+|\n+|(?<=[。！？｡])(?![。！？｡])[」』”’）》〉】〕]*\s*")
#: A word runs from blank to blank; where a script has no blanks, each character is one.
_WORD = re.compile(rf"[{_WIDE}][^\w\s]*|[^\s{_WIDE}]+")
#: The same for texts without any of these characters, and faster.
_PLAIN_STOP, _PLAIN_WORD = re.compile(r"(?<=[.!?])\s+|\n+"), re.compile(r"\S+")
_IS_WIDE = re.compile(rf"[{_WIDE}。！？｡]").search


@lru_cache(REMEMBER)
def _rank(word: str) -> int:
    """A word's place in the order by which cuts are chosen: the same in every process."""
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def cuts(words: list[str], window: int = WINDOW) -> list[int]:
    """The words after which a long sentence is cut: of every ``window`` consecutive words that of
    least rank, the last one of equals. A cut depends only on words less than ``window`` away, so
    a passage has the same cuts inside whatever stands before it."""
    rank = list(map(_rank, words))
    out, at = [], -1
    for end in range(window, len(rank) + 1):
        if at < end - window:
            low = min(rank[end - window:end])
            at = end - 1
            while rank[at] != low:
                at -= 1
        elif rank[end - 1] <= rank[at]:
            at = end - 1
        else:
            continue
        out.append(at)
    return out


def sentences(text: str, longest: int = LONGEST) -> list[tuple[int, int, int]]:
    """(start, end, words) of each sentence: cut after stops and at line ends; those of more than
    ``longest`` words in pieces (see :func:`cuts`).

    A sentence starts at its first word; what stands between it and the next belongs to it.
    """
    out, at = [], 0
    plain = text.isascii() or not _IS_WIDE(text)
    stops, word = (_PLAIN_STOP, _PLAIN_WORD) if plain else (_STOP, _WORD)
    for stop in itertools.chain((m.span() for m in stops.finditer(text)), [(len(text), len(text))]):
        words = [m.start() for m in word.finditer(text, at, stop[0])]
        if len(words) > longest:
            first = 0
            for last in cuts(word.findall(text, at, stop[0])):
                if last + 1 < len(words):
                    out.append((words[first], words[last + 1], last + 1 - first))
                    first = last + 1
            out.append((words[first], stop[1], len(words) - first))
        elif words:
            out.append((words[0], stop[1], len(words)))
        at = stop[1]
    return out


def runs(text: str, least: int = SENTENCES, words: int = WORDS) -> list[tuple[int, int]]:
    """(first, number of sentences) of the shortest run from each sentence that is long enough."""
    return _runs(sentences(text), least, words)


def _runs(got: list[tuple[int, int, int]], least: int, words: int) -> list[tuple[int, int]]:
    total = np.concatenate(([0], np.cumsum([n for _, _, n in got], dtype=np.int64)))
    first = np.arange(len(got))
    end = np.maximum(first + least, np.searchsorted(total, total[first] + words))
    ok = end <= len(got)
    return list(zip(first[ok].tolist(), (end - first)[ok].tolist()))


def _pieces(text: str):
    """(start, end, words, normal text) of each sentence as :func:`sentences` cuts them; the normal text has
    one blank where white space stood. Texts in scripts with blanks are split into words only once."""
    if not text.isascii() and _IS_WIDE(text):
        for a, b, n in sentences(text):
            yield a, b, n, " ".join(text[a:b].split())
        return
    at = 0
    for stop in itertools.chain((m.span() for m in _PLAIN_STOP.finditer(text)), [(len(text), len(text))]):
        if stop[0] > at:
            part = text[at:stop[0]]
            words = part.split()
            if len(words) > LONGEST:
                starts = [at + m.start() for m in _PLAIN_WORD.finditer(part)]
                first = 0
                for last in cuts(words):
                    if last + 1 < len(words):
                        yield starts[first], starts[last + 1], last + 1 - first, " ".join(words[first:last + 1])
                        first = last + 1
                yield starts[first], stop[1], len(words) - first, " ".join(words[first:])
            elif words:
                yield at + len(part) - len(part.lstrip()), stop[1], len(words), " ".join(words)
        at = stop[1]


#: Odd factors of the two sums that make a run's hash of its sentences' hashes, and their inverses modulo 2**64.
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_INVERSES = tuple(pow(f, -1, 1 << 64) for f in _FACTORS)


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n + 1, factor, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _run_hashes(hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each run of rows ``first`` to ``end`` of ``hashes`` (two columns): the sum of
    the rows' hashes times powers of a factor that count from the run's start, by running sums, so a
    sentence is hashed once however many runs it is in."""
    out = []
    for lane, (factor, inverse) in enumerate(zip(_FACTORS, _INVERSES)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[:, lane] * _powers(factor, len(hashes))[:-1])])
        h = (sums[end] - sums[first]) * _powers(inverse, len(hashes))[first] + (end - first).astype(np.uint64) * np.uint64(factor)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_FACTORS[1 - lane])
        out.append((h ^ (h >> np.uint64(32))).view(np.int64))
    return out


#: A mark is packed into two numbers: sentence and number of sentences, first and last character. One with a
#: negative first number says how many sentences its text has.
_MOST = 1 << 16


_NONE = np.zeros(0, np.int64), np.zeros(0, np.int64)


def _pack(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return (a.astype(np.int64) << bits) | b


def span_rows(docs: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """(h, g, did, th, at, chars, known): every run of every text, and one row a text with its number of
    sentences. Of equal runs in a batch only the first goes on as itself; the others are ``known``
    repeats and are dealt by their own place, so a run that a third of the texts have is one row a batch."""
    if max(least, words) >= _MOST:
        raise ValueError(f"runs are of less than {_MOST} sentences")

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for b in sized_batches(batches, BATCH_BYTES):
            # by place, so that of equal runs the first in the batch is the first in the corpus
            b = b.take(pa.array(np.lexsort((ints(b, "th"), ints(b, "did")))))
            did, th = ints(b, "did"), ints(b, "th")
            start, end, many, digests, count = [], [], [], [], []
            for t in b.column("text"):
                was = len(start)
                for a, e, n, part in _pieces(t.as_py()):
                    start.append(a)
                    end.append(e)
                    many.append(n)
                    digests.append(digest(part.encode("utf-8", "surrogatepass")))
                count.append(len(start) - was)
            count = np.array(count, np.int64)
            last = np.cumsum(count)
            start, end = np.array(start, np.int64), np.array(end, np.int64)
            total = np.concatenate(([0], np.cumsum(np.array(many, np.int64))))
            first = np.arange(len(start))
            stop = np.maximum(first + least, np.searchsorted(total, total[:-1] + words))
            row = np.repeat(np.arange(len(count)), count)
            ok = stop <= last[row]
            first, stop, row = first[ok], stop[ok], row[ok]
            h, g = _run_hashes(np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2), first, stop)
            pos = first - (last - count)[row]
            order = np.argsort(h, kind="stable")
            new = np.ones(len(order), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
            head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            same = (did[row[order]] == did[row[head]]) & (th[row[order]] == th[row[head]]) & (pos[order] == pos[head])
            o = order[new | ~same]
            known = ~new[new | ~same]
            r = row[o]
            again = np.concatenate([np.zeros(1, bool), (did[1:] == did[:-1]) & (th[1:] == th[:-1])])
            some = np.flatnonzero((count > 0) & ~again)  # repeated rows are one place
            own = did * 31 + th  # rows that need no partner are dealt by their place
            yield pa.RecordBatch.from_pydict({
                "h": np.concatenate([np.where(known, own[r] + pos[o], h[o]), own[some] - 1]),
                "g": np.concatenate([g[o], np.zeros(len(some), np.int64)]),
                "did": np.concatenate([did[r], did[some]]), "th": np.concatenate([th[r], th[some]]),
                "at": np.concatenate([_pack(pos[o], (stop - first)[o], 16), -count[some]]),
                "chars": np.concatenate([_pack(start[first[o]], end[stop[o] - 1], 32), np.zeros(len(some), np.int64)]),
                "known": pa.array(np.concatenate([known, np.ones(len(some), bool)]))})

    return docs.mapInArrow(run, "h long, g long, did long, th long, at long, chars long, known boolean")


def _united(chars: np.ndarray) -> list[tuple[int, int]]:
    """The packed character spans, joined where they touch or overlap."""
    out = []
    for c in np.sort(chars).tolist():
        a, e = c >> 32, c & 0xFFFFFFFF
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((a, e))
    return out


def remove_repeated_sentences(docs: DataFrame, least: int = SENTENCES, words: int = WORDS, id_col: str = "doc_id",
                              text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_sentences, n_removed, removed (sentence numbers), kept_text.

    A sentence goes if a run that covers it also starts earlier: in a document of smaller id
    or before in the same one. Runs are those of the input. Texts without a long enough run,
    null and empty texts lose nothing (kept_text of null is empty). Null ids come first, equal
    ids are ordered by text hash, rows with equal id and text are one place and get the same
    result. Other columns are not read; texts are never cut. An empty table gives no rows.

    Runs are shuffled once, by hash; the marks that come out carry the characters they cover, so
    a text is cut into sentences once.
    """
    rows = keyed(docs, id_col, text_col)
    later = later_copies(span_rows(rows, least, words), ["h", "g"], ["did", "th", "at"], always="known")
    marks = settled(later.select("did", "th", "at", "chars"), "marks")
    per_text = marks.groupBy("did", "th").agg(F.collect_set(F.struct("at", "chars")).alias("spans"))

    def run(batches):
        for b in sized_batches(batches, BATCH_BYTES):
            total, gone, kept = [], [], []
            for i in range(b.num_rows):
                text, spans = b.column("text")[i].as_py(), b.column("spans")[i].values
                at, chars = (spans.field(j).to_numpy(zero_copy_only=False) for j in range(2)) if spans is not None else _NONE
                total.append(int(-at.min(initial=0)))
                chars, at = chars[at >= 0], at[at >= 0]
                drop = np.zeros(total[-1] + 1, np.int64)
                np.add.at(drop, at >> 16, 1)
                np.add.at(drop, (at >> 16) + (at & (_MOST - 1)), -1)
                gone.append(np.flatnonzero(np.cumsum(drop[:-1]) > 0).tolist())
                if len(at):
                    out, upto = [], len(text) - len(text.lstrip())  # the first sentence's start
                    for a, e in _united(chars):
                        out.append(text[upto:a])
                        upto = e
                    text = "".join(out) + text[upto:]
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [b.column("did"), pa.array(total, pa.int64()), pa.array([len(x) for x in gone], pa.int64()),
                 pa.array(gone, pa.list_(pa.int64())), pa.array(kept, pa.string())],
                ["doc_id", "n_sentences", "n_removed", "removed", "kept_text"])

    out = rows.join(per_text, ["did", "th"], "left").select("did", "text", "spans").mapInArrow(
        run, "doc_id long, n_sentences long, n_removed long, removed array<long>, kept_text string")
    return out.withColumn("doc_id", real_id("doc_id"))


def brute_force(docs: list[tuple], least: int = SENTENCES, words: int = WORDS) -> list[tuple]:
    """(id, sentences, removed sentence numbers) for small inputs, by the text of each run."""
    seen, out = set(), []
    for d, text in sorted(docs, key=lambda x: x[0]):
        text = text or ""
        part = [" ".join(text[a:b].split()) for a, b, _ in sentences(text)]
        gone = set()
        for first, n in runs(text, least, words):
            key = tuple(part[first:first + n])
            if key in seen:
                gone.update(range(first, first + n))
            seen.add(key)
        out.append((d, len(part), sorted(gone)))
    return out
