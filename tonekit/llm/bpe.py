"""Byte-level BPE over length-bucketed numpy matrices.

Texts are cut into pieces by the tokenizer's pattern; distinct pieces are merged together as
rows of a matrix: every round each row merges its leftmost pair of minimum rank. All rows of
a matrix lose one cell a round, so compaction is one mask; rows without a pair leave.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed, sized_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of text taken at once, and distinct units a worker remembers.
BATCH_BYTES = 1 << 20
REMEMBER = 150_000
#: Cells of a matrix of pieces, a megabyte; a round has some ten arrays of that size at once.
MATRIX_CELLS = 1 << 17
#: Longer pieces are merged with a heap: the matrix takes a round for each merge.
MATRIX_BYTES = 256
_NONE = np.int64(1 << 40)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class PairTable:
    """Open-addressed table from an id pair to the id of the joined bytes (its rank)."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        bits = int(np.ceil(np.log2(max(4, 4 * len(pairs)))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int64)
        slot, left = self._slot(pairs), np.arange(len(pairs))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] == -1
            take = left[free]
            _, firsts = np.unique(slot[take], return_index=True)
            put = take[firsts]
            self.keys[slot[put]], self.ranks[slot[put]] = pairs[put], ranks[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * _MULTIPLIER) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where it doesn't merge (negative ids never do)."""
        out = np.full(a.shape, _NONE, np.int64)
        todo = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        pair = (a.ravel()[todo] << 32) | b.ravel()[todo]
        slot, flat = self._slot(pair), out.ravel()
        for _ in range(self.probes):
            if not len(todo):
                break
            key = self.keys[slot]
            hit = key == pair
            flat[todo[hit]] = self.ranks[slot[hit]]
            go = ~hit & (key != -1)
            todo, pair, slot = todo[go], pair[go], (slot[go] + 1) & self.mask
        return flat.reshape(a.shape)


class Bpe:
    """Encoder and decoder for one rank file; ``pattern`` cuts texts into pieces."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r) for t, r in self.ranks.items()
                 for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        key, rank = np.array(pairs, np.int64).T
        self.table = PairTable(np.ascontiguousarray(key), np.ascontiguousarray(rank))
        self.numbers: dict[str, int] = defaultdict()  # a unit that is asked for gets the next number
        self.numbers.default_factory = self.numbers.__len__
        self.known: list[tuple] = []  # ids of each number's unit
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.whole = list(range(len(self.tokens)))  # one object an id, however many pieces hold it

    # -- merging ---------------------------------------------------------------------------
    def merge_matrix(self, ids: np.ndarray) -> list[np.ndarray]:
        """Merged rows of a matrix padded with -1."""
        out: list = [None] * len(ids)
        row = np.arange(len(ids))
        rank = self.table.rank(ids[:, :-1], ids[:, 1:])
        while True:
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(ids), np.int64)
            value = rank[np.arange(len(ids)), best] if rank.shape[1] else np.full(len(ids), _NONE)
            done = value == _NONE
            if done.any():
                for r, x in zip(row[done].tolist(), ids[done]):
                    out[r] = x[x >= 0]
                ids, rank, row, best, value = ids[~done], rank[~done], row[~done], best[~done], value[~done]
            if not len(ids):
                return out
            n, width = ids.shape
            each = np.arange(n)
            ids[each, best] = value
            keep = np.ones((n, width), bool)
            keep[each, best + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[each, best] = False
            rank = rank[keep].reshape(n, width - 2)
            left = np.flatnonzero(best > 0)
            if len(left):
                b = best[left]
                rank[left, b - 1] = self.table.rank(ids[left, b - 1], ids[left, b])
            right = np.flatnonzero(best < width - 2)
            if len(right):
                b = best[right]
                rank[right, b] = self.table.rank(ids[right, b], ids[right, b + 1])

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = [int(self.byte[b]) for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tokens, ranks = self.tokens, self.ranks

        def rank(i: int):
            j = after[i]
            return ranks.get(tokens[ids[i]] + tokens[ids[j]]) if j < n else None

        heap = [(r, i) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank(i) != r:
                continue
            j = after[i]
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (q := rank(x)) is not None:
                    heapq.heappush(heap, (q, x))
        return [x for x in ids if x >= 0]

    def merge(self, pieces: list[bytes]) -> list[tuple]:
        """Ids of each piece. A piece that is a token is that token."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = (r,)
            elif len(p) > MATRIX_BYTES:
                out[i] = tuple(self.merge_long(p))
            else:
                buckets.setdefault((len(p) + 3) // 4, []).append(i)
        for quarter, rows in buckets.items():
            width = 4 * quarter
            step = MATRIX_CELLS // width
            for s in range(0, len(rows), step):
                some = rows[s:s + step]
                raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in some), np.uint8)
                ids = self.byte[raw.reshape(-1, width)]
                size = np.array([len(pieces[i]) for i in some])
                ids[np.arange(width) >= size[:, None]] = -1
                for i, x in zip(some, self.merge_matrix(ids)):
                    out[i] = tuple([self.whole[k] for k in x.tolist()])
        return out

    # -- texts -----------------------------------------------------------------------------
    def units(self, text: str) -> list[str]:
        """Pieces, or longer units whose pieces don't depend on what stands around them.

        A blank starts a piece unless white space stands before it and white space or the
        end after it. Other texts can be cut at their blanks, and each part be cut by the
        pattern only once, however often it occurs.
        """
        if _INNER_BLANK(text):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def encoded(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each text. A batch's units are held as numbers, four bytes each; the units
        themselves and the ids are there for one text at a time."""
        numbers, known = self.numbers, self.known
        if len(known) > REMEMBER:
            numbers.clear()
            known.clear()
        cut = [array("i", map(numbers.__getitem__, self.units(t))) for t in texts]
        parts = [self.pattern.findall(u) for u in itertools.islice(numbers, len(known), None)]
        pieces = list(set(itertools.chain.from_iterable(parts)))
        ids = dict(zip(pieces, self.merge([p.encode("utf-8", "surrogatepass") for p in pieces])))
        known.extend([ids[ps[0]] if len(ps) == 1 else tuple(itertools.chain.from_iterable([ids[p] for p in ps]))
                      for ps in parts])
        del parts, pieces, ids
        for c in cut:
            yield list(itertools.chain.from_iterable(map(known.__getitem__, c)))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return list(self.encoded(texts))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_INNER_BLANK = re.compile(r"\s (?:\s|\Z)").search


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> Bpe:
    """One encoder per worker process."""
    return Bpe(path, pattern)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, ids.

    Null texts count as empty and have no ids; repeated rows are encoded row by row; a long
    text is one list of ids, its pieces of over MATRIX_BYTES bytes are merged with a heap.
    Other columns are not read. An empty table gives no rows. ``path`` names a rank file that
    every executor can read.
    """
    import public_tokenizers

    path, pattern = path or vocabulary_path(), pattern or public_tokenizers.PATTERN
    sha = hashlib.sha256

    def run(batches):
        bpe = load(path, pattern)
        for b in sized_batches(batches, BATCH_BYTES):
            n, ids_sha, decoded_sha, flat = [], [], [], array("i")
            for ids in bpe.encoded(t.as_py() for t in b.column("text")):
                n.append(len(ids))
                ids_sha.append(sha(" ".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(sha(bpe.decode(ids)).hexdigest())
                flat.extend(ids)
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("did"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": ids_sha,
                "decoded_sha256": decoded_sha,
                "ids": pa.ListArray.from_arrays(np.cumsum([0, *n]).astype(np.int32), np.array(flat, np.int32))})

    from .common import real_id

    out = keyed(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")
    return out.withColumn("doc_id", real_id("doc_id"))
