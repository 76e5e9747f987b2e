"""Token ids in grammar-compressed shards (Re-Pair), written in id order and read back.

A shard holds the ids of consecutive documents. Frequent pairs of neighbouring symbols are
replaced by nonterminals, round after round; the shard keeps the rules, how many ids each
nonterminal stands for, the symbols that are left, and each document's number of ids. A
document is read by finding its symbols from the expansion lengths and expanding only those.
"""
from __future__ import annotations

import itertools
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ints, keyed, real_id, settled, sized_batches

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Bytes of text in a shard, about.
BATCH_BYTES = 8 << 20
REMEMBER = 700_000
#: New chunks that are encoded in one text.
TOGETHER = 4096
#: Symbols are stored in 16 bits; nonterminals start above the largest id.
SYMBOLS = 1 << 16
PAIRS = 4096
LEAST = 24
#: Rounds end when one removes less than this share of the symbols.
GAIN = 0.08

SHARD = ("part int, seq int, start long, total long, dids binary, ths binary, counts binary, "
         "base int, rules binary, lengths binary, symbols binary")


class Lists:
    """Lists of ids by name, in growing arrays: name -> code -> place and size in one flat array."""

    def __init__(self):
        self.code: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint16), 0
        self.first, self.size = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def __len__(self) -> int:
        return len(self.code)

    def add(self, names: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n, total = len(self.code), len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(names) > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        self.size[n:n + len(names)] = size
        self.first[n:n + len(names)] = self.used + np.cumsum(size) - size
        self.flat[self.used:self.used + total] = ids
        self.used += total
        self.code.update(zip(names, range(n, n + len(names))))

    def joined(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the lists one after another, size of each)."""
        size = self.size[code]
        ends = np.cumsum(size, dtype=np.int64)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[code] - ends + size, size)
        return self.flat[at], size


class Encoder:
    """Ids of whole texts by the tokenizers library.

    The library's pattern never crosses white space, so each chunk between white space is
    encoded once and remembered. Of a new chunk that is a plain word with marks behind it, word
    and marks are told apart, as the pattern does, and the lower-case word is looked up; a new
    one needs the library's model alone. Other new pieces go to the whole library many at a
    time, in one text with an added token of the file between each two: the library takes added
    tokens out first and treats what stands between them apart, as it would pieces alone, and no
    piece holds one.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        if self.tok.get_vocab_size() > SYMBOLS:
            raise ValueError(f"ids are stored in 16 bits; the vocabulary has {self.tok.get_vocab_size()}")
        self.added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        # the longest first, as the library does; without added tokens nothing matches
        self.parts = re.compile("(" + ("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)") + ")")
        self.between = min(self.added, default=None)
        self.blank = regex.compile(r"\s+")
        self.model = self.tok.model.tokenize
        # FIXED VALUES: the byte alphabet of the tokenizer file
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.bytes = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.pieces = Lists()
        self.forget()

    def forget(self) -> None:
        """Start anew, with the chunks that came more than once if they are few enough."""
        old = getattr(self, "chunks", None)
        self.chunks = Lists()
        # code 0 ends a text, code 1 is what stands before blanks at a text's start and behind those at its end
        self.chunks.add([_END, ""], np.array([END_ID]), np.array([1, 0]))
        if old is not None:
            often = self.seen[:len(old)] > 1
            often[:2] = False
            if often.sum() < REMEMBER // 2:
                self.chunks.add(list(itertools.compress(old.code, often.tolist())), *old.joined(np.flatnonzero(often)))
        self.seen = np.zeros(len(self.chunks), np.int32)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of plain words in lower case, by the library's model."""
        spelt = [w if w.isascii() else w.encode("utf-8").decode("latin-1").translate(self.bytes) for w in words]
        ids = [[t.id for t in self.model(w)] for w in spelt]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(size.sum())), size

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each), by the whole library."""
        ids, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        together = TOGETHER if self.between else 1
        mark = self.added[self.between] if self.between else -1
        for a in range(0, len(pieces), together):
            some = (self.between or "").join(pieces[a:a + together])
            got = np.array(self.tok.encode_batch_fast([some], add_special_tokens=False)[0].ids, np.int64)
            cut = np.flatnonzero(got == mark)
            ids.append(np.delete(got, cut))
            size.append(np.diff(np.concatenate(([-1], cut, [len(got)]))) - 1)
        return np.concatenate(ids), np.concatenate(size)

    def _learn(self, chunks: list[str]) -> None:
        if len(self.pieces) > REMEMBER:
            self.pieces = Lists()
        if not len(self.pieces):
            self.pieces.add(["", *self.added], np.array(list(self.added.values()), np.int64), np.array([0] + [1] * len(self.added)))
        # each chunk as two pieces: a plain word in lower case and the marks behind it, or all of it and nothing
        heads, marks = [], {}
        for i, c in enumerate(chunks):
            word = c.rstrip(_MARKS)
            if _plain(word):
                heads.append(word.lower())
                if len(word) < len(c):
                    marks[i] = c[len(word):]
            else:
                heads.append(c)
        new = [x for x in dict.fromkeys(itertools.chain(heads, marks.values())) if x not in self.pieces.code]
        plain = list(map(_plain, new))
        words, others = list(itertools.compress(new, plain)), [x for x, p in zip(new, plain) if not p]
        self.pieces.add(words, *self._words(words))
        self.pieces.add(others, *self._encoded(others))
        code, find = np.zeros((len(chunks), 2), np.int64), self.pieces.code.__getitem__  # code 0: no ids
        code[:, 0] = np.fromiter(map(find, heads), np.int64, len(heads))
        code[list(marks), 1] = np.fromiter(map(find, marks.values()), np.int64, len(marks))
        ids, size = self.pieces.joined(code.ravel())
        self.chunks.add(chunks, ids, size.reshape(-1, 2).sum(axis=1))

    def _codes(self, chunks: list[str]) -> np.ndarray:
        """The code of every chunk; those not met before are learnt."""
        code = np.fromiter(map(self.chunks.code.get, chunks, itertools.repeat(-1)), np.int32, len(chunks))
        missing = np.flatnonzero(code < 0)
        if len(missing):
            new = [chunks[i] for i in missing.tolist()]
            names = list(dict.fromkeys(new))
            n = len(self.chunks)
            self._learn(names)
            # names without repeats have got the codes from n on in their order
            code[missing] = np.arange(n, n + len(new)) if len(names) == len(new) else [self.chunks.code[c] for c in new]
        return code

    def _parts(self, text: str) -> list[str]:
        """The chunks of a text that may hold added tokens or the separators 1C to 1F, which are white
        space to Arrow and Python but not to the library."""
        return [x for part in self.parts.split(text) for x in self.blank.split(part) if x]

    def batch(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each ended by END_ID; number of ids of each text). ``texts``: strings, as a
        list or an Arrow array. Arrow splits them and finds equal chunks, so that a chunk of the batch is
        one Python string and one look-up, however often it stands there."""
        if len(self.chunks) > REMEMBER:
            self.forget()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        own = pc.match_substring_regex(texts, "[\x1c-\x1f]")
        for a in self.added:
            own = pc.or_(own, pc.match_substring(texts, a))
        special = np.flatnonzero(own.to_numpy(zero_copy_only=False))
        lists = pc.utf8_split_whitespace(pc.if_else(own, "", texts) if len(special) else texts)
        each = lists.flatten().dictionary_encode()
        code = self._codes(each.dictionary.to_numpy(zero_copy_only=False).tolist())[each.indices.to_numpy()] if len(each) else np.zeros(0, np.int32)
        ends = lists.offsets.to_numpy()[1:].astype(np.int64)  # of each text's chunks
        if len(special):
            more = [self._codes(self._parts(texts[i].as_py())) for i in special.tolist()]
            n = np.zeros(len(ends), np.int64)
            n[special] = list(map(len, more))
            code = np.insert(code, np.repeat(ends[special], n[special]), np.concatenate(more))
            ends = ends + np.cumsum(n)
        code = np.insert(code, ends, 0)  # the end of a text has code 0
        seen = np.bincount(code, minlength=len(self.chunks)).astype(np.int32)
        seen[:len(self.seen)] += self.seen
        self.seen = seen
        ids, size = self.chunks.joined(code)
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(size, dtype=np.int64)])
        return ids, np.diff(upto[np.concatenate([np.zeros(1, np.int64), ends + np.arange(1, len(ends) + 1)])])


def _plain(word: str) -> bool:
    """Letters alone, below U+0250, where composing, lower-casing and letters are the same in Python and
    the library. Lower case of a plain word may lie beyond; it is no plain word then."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


#: Marks that the library's pattern parts from the word before them and keeps together. The apostrophe is not
#: one: with some letters it is a piece of its own.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Stands for the end of a text among its chunks; no chunk holds a blank.
_END = " end "


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def compress(ids: np.ndarray, base: int, pairs: int = PAIRS, least: int = LEAST, gain: float = GAIN):
    """(rules, lengths, symbols): each round gives the most frequent pairs of neighbours (at
    least ``least`` occurrences) a nonterminal and replaces them from left to right."""
    x, rules = ids.astype(np.uint32), np.zeros((0, 2), np.uint32)
    length = np.ones(SYMBOLS, np.int64)
    was = np.inf
    while len(x) <= (1 - gain) * was:
        was = len(x)
        room = min(pairs, SYMBOLS - base - len(rules))
        if len(x) < 2 * least or room <= 0:
            break
        both = (x[:-1] << 16) | x[1:]
        ordered = np.sort(both)
        begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        count = np.diff(begin, append=len(ordered))
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        if len(often) > room:
            often = often[np.argpartition(count[often], len(often) - room)[-room:]]
        chosen = np.sort(ordered[begin[often]])
        # each chosen pair's number, by a table over the left and right symbols that occur in one
        lefts, rights = np.unique(chosen >> 16), np.unique(chosen & 0xFFFF)
        left, right = np.zeros(SYMBOLS, np.int32), np.zeros(SYMBOLS, np.int32)
        left[lefts] = np.arange(1, len(lefts) + 1) * (len(rights) + 1)
        right[rights] = np.arange(1, len(rights) + 1)
        number = np.full((len(lefts) + 1) * (len(rights) + 1), -1, np.int16)  # PAIRS at most
        number[left[chosen >> 16] + right[chosen & 0xFFFF]] = np.arange(len(chosen))
        slot = number[left[x[:-1]] + right[x[1:]]]
        at = np.flatnonzero(slot >= 0)
        slot = slot[at].astype(np.int32)
        # of neighbouring occurrences that share a symbol, every second one from the left
        run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - run) % 2 == 0
        at, slot = at[take], slot[take]
        new = base + len(rules)
        rules = np.concatenate([rules, np.stack([chosen >> 16, chosen & 0xFFFF], 1).astype(np.uint32)])
        length[new:new + len(chosen)] = length[chosen >> 16] + length[chosen & 0xFFFF]
        x[at] = new + slot
        keep = np.ones(len(x), bool)
        keep[at + 1] = False
        x = x[keep]
    return rules, length[base:base + len(rules)], x


def _by_levels(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that ``symbols`` stand for; one pass for each level of the grammar."""
    x = symbols.astype(np.int64)
    while len(at := np.flatnonzero(x >= base)):
        wide = np.ones(len(x), np.int64)
        wide[at] = 2
        out = np.repeat(x, wide)
        place = (np.cumsum(wide) - wide)[at]
        out[place], out[place + 1] = rules[x[at] - base, 0], rules[x[at] - base, 1]
        x = out
    return x


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids that ``symbols`` stand for: the rules are expanded level by level, once, and every symbol
    then copies its own expansion."""
    table = np.concatenate([np.arange(base, dtype=np.uint16), _by_levels(base + np.arange(len(rules)), rules, base).astype(np.uint16)])
    size = np.concatenate([np.ones(base, np.int32), lengths.astype(np.int32)])
    first = (np.cumsum(size) - size).astype(np.int32)
    many = size[symbols]
    ends = np.cumsum(many, dtype=np.int64)
    return table[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[symbols] - ends + many, many)]


def read_range(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int, start: int, end: int):
    """Ids ``start`` to ``end`` of a shard, expanding only the symbols that cover them."""
    size = np.ones(len(symbols), np.int64)
    big = symbols >= base
    size[big] = lengths[symbols[big].astype(np.int64) - base]
    ends = np.cumsum(size)
    a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, end, side="left") + 1
    skip = start - (ends[a - 1] if a else 0)
    return expand(symbols[a:b], rules, lengths, base)[skip:skip + end - start]


def gathered(batches, limit: int):
    """Consecutive Arrow batches joined to about ``limit`` bytes of text; larger ones are cut."""
    held, size = [], 0
    for b in sized_batches(batches, limit):
        more = pc.sum(pc.binary_length(b.column("text"))).as_py() or 0
        if held and size + more > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(b)
        size += more
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def write_shards(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shards of all documents in ascending id order, written to the shared folder.

    Texts are dealt by ranges of (id, text hash), sorted, encoded and compressed where they
    land; ``part`` and ``seq`` number the shards in that order and ``start`` counts the ids
    before a shard in its part.
    """
    import public_tokenizers

    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        from pyspark import TaskContext

        part, seq, start = TaskContext.get().partitionId(), 0, 0
        enc = encoder(path)
        base = enc.tok.get_vocab_size()
        for b in gathered(batches, BATCH_BYTES):
            ids, counts = enc.batch(b.column("text"))
            rules, lengths, symbols = compress(ids, base)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "start": [start], "total": [len(ids)],
                "dids": [ints(b, "did").astype("<i8").tobytes()], "ths": [ints(b, "th").astype("<i8").tobytes()],
                "counts": [counts.astype("<i8").tobytes()], "base": pa.array([base], pa.int32()),
                "rules": [rules.astype("<u2").tobytes()], "lengths": [lengths.astype("<i8").tobytes()],
                "symbols": [symbols.astype("<u2").tobytes()]})
            seq, start = seq + 1, start + len(ids)

    rows = keyed(docs, id_col, text_col).repartitionByRange("did", "th").sortWithinPartitions("did", "th")
    return settled(rows.mapInArrow(run, SHARD), "tokens")


def read_shards(shards: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row per document from the written shards: doc_id, start, n_tokens, ids_crc32, ids. Without
    ``with_ids`` the ids stay where they are read; the other columns are the same."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                counts = np.frombuffer(r["counts"], "<i8")
                ids = expand(np.frombuffer(r["symbols"], "<u2"), np.frombuffer(r["rules"], "<u2").reshape(-1, 2),
                             np.frombuffer(r["lengths"], "<i8"), r["base"]).astype("<u4")
                ends = np.cumsum(counts)
                docs = [ids[e - c:e] for e, c in zip(ends.tolist(), counts.tolist())]
                cols = {"part": pa.array([r["part"]] * len(counts), pa.int32()),
                        "did": np.frombuffer(r["dids"], "<i8"), "local": r["start"] + ends - counts, "n_tokens": counts,
                        "ids_crc32": pa.array([zlib.crc32(d.tobytes()) for d in docs], pa.int64())}
                if with_ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(cols)

    rows = shards.mapInArrow(run, "part int, did long, local long, n_tokens long, ids_crc32 long"
                             + (", ids array<int>" if with_ids else ""))
    # one row a part: the running sum is over as many rows as the writing job had tasks
    sums = shards.groupBy("part").agg(F.max(F.col("start") + F.col("total")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = settled(sums.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "bases")
    return rows.join(base, "part").select(
        real_id().alias("doc_id"), (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []))


def token_table(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                with_ids: bool = True) -> DataFrame:
    """One row per document, read back from the written shards: doc_id, start, n_tokens, ids_crc32, ids.

    Null texts count as empty and hold the end id alone. Null ids come first; rows with equal
    ids are ordered by text hash; repeated rows each have their own ids. Other columns are not
    read. A very long text is a shard of its own. An empty table gives no rows.
    """
    return read_shards(write_shards(docs, path, id_col, text_col), with_ids)
