"""SimHash near-duplicates with pivot distance tables.

A fingerprint's distances to reference fingerprints (pivots) are written once. Two
fingerprints within t bits differ by t at most in every such distance, so a pair whose
largest difference is over t is discarded without looking at the fingerprints; what is left
is verified by the exact bit distance.

Distances to pivots alone don't say which pairs to look at: those of unlike fingerprints lie
close together, and every pair would have to be compared. Pairs are therefore met in
buckets: a fingerprint is cut into m blocks, t bits touch t blocks at most, so two linked
fingerprints agree on some choice of m - t blocks. No pair is missed. m grows with the
number of fingerprints, which changes the work and not the links.
"""
from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, ints, keyed, real_id, settled

SHINGLE = 4
MAX_BITS = 4
SEED = 42
PIVOTS = 16
#: Fingerprints that one task compares with each other; larger buckets are dealt out.
CHUNK = 2048
#: Mean fingerprints in a bucket from which one more block is used.
BUCKET = 64
_SHINGLES_AT_ONCE = 1 << 15


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints by rule: the first n outputs of splitmix64 from 0."""
    out, mask = [], (1 << 64) - 1
    for i in range(1, n + 1):
        z = i * 0x9E3779B97F4A7C15 & mask
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        out.append(z ^ z >> 31)
    return out


def fingerprint(text: str, k: int = SHINGLE) -> int:
    """Unsigned fingerprint of one text: bit set where over half the shingle hashes have it."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < k:
        return digest(b" ".join(words), SEED)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    m = len(words) - k + 1
    votes = np.zeros(64, np.int64)
    for i in range(0, m, _SHINGLES_AT_ONCE):
        j = min(m, i + _SHINGLES_AT_ONCE)
        h = np.array([digest(whole[a:b], SEED) for a, b in
                      zip(starts[i:j].tolist(), ends[i + k - 1:j + k - 1].tolist())], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > m, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(did, th, fp): the fingerprint of every row, as a signed 64-bit integer."""
    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), k) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("th"), pa.array(fp.view(np.int64))],
                                             ["did", "th", "fp"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "did long, th long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(n: int, bits: int) -> int:
    """Blocks to cut a fingerprint into for n fingerprints: at least bits + 1."""
    m = bits + 1
    while m < bits + 5 and n / 2 ** (64 * (m - bits) / m) > BUCKET:
        m += 1
    return m


def _bucket_keys(bits: int, m: int) -> list:
    """One column for each choice of m - bits blocks: the fingerprint under that mask."""
    edges = [64 * i // m for i in range(m + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [F.struct(F.lit(j).alias("block"), F.col("fp").bitwiseAND(F.lit(_signed(sum(c)))).alias("key"))
            for j, c in enumerate(itertools.combinations(masks, m - bits))]


def _near(fp: np.ndarray, coords: np.ndarray, same: np.ndarray, bits: int):
    """A spanning forest of the pairs within ``bits`` among rows of equal ``same`` (sorted).

    For each shift: pairs that are joined already go, then one pivot after another discards
    pairs, then the rest is verified.
    """
    n, links = len(fp), []
    part = np.arange(n)  # part[part[i]] == part[i] between shifts
    at, shift = np.arange(n - 1), 1
    while len(at):
        at = at[at + shift < n]
        at = at[same[at] == same[at + shift]]
        a = at[part[at] != part[at + shift]]
        b = a + shift
        for p in range(coords.shape[1]):
            if not len(a):
                break
            ok = np.abs(coords[a, p] - coords[b, p]) <= bits
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= bits
        for x, y in zip(a[ok].tolist(), b[ok].tolist()):
            rx, ry = x, y
            while part[rx] != rx:
                rx = part[rx]
            while part[ry] != ry:
                ry = part[ry]
            if rx != ry:
                part[max(rx, ry)] = min(rx, ry)
                links.append((x, y))
        if ok.any():
            while (part != part[part]).any():
                part = part[part]
        shift += 1
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def links(prints: DataFrame, bits: int = MAX_BITS, n_pivots: int = PIVOTS) -> DataFrame:
    """(a, b): enough links between the distinct fingerprints of ``prints`` (fp) within ``bits``
    that their components are those of all links.

    A bucket over CHUNK members is dealt to chunks by hash, and every pair of chunks meets in
    a task of its own: no task holds more than two chunks of a bucket. A task returns a
    spanning forest of what it linked, never all pairs.
    """
    table = settled(prints.select("fp").distinct().withColumn(
        "coords", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("byte")
                            for p in pivots(n_pivots)])), "pivots")
    m = _blocks(table.count(), bits)
    rows = table.select("fp", "coords", F.explode(F.array(*_bucket_keys(bits, m))).alias("s")).select(
        "fp", "coords", "s.block", "s.key")
    sizes = (rows.groupBy("block", "key").agg(F.count("*").alias("n")).filter("n > 1")
             .withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")).drop("n"))
    dealt = (rows.join(sizes, ["block", "key"])
             .withColumn("c", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
             .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select("block", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp", "coords"))
    order = ["block", "key", "i", "j"]

    def run(batches):
        held = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
                held = t.to_batches()[0] if t.num_rows else None
            if held is None:
                continue
            n = held.num_rows
            cols = [ints(held, c) for c in order]
            new = np.ones(n, bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            group = np.cumsum(new)
            cut = n if b is None else int(np.flatnonzero(new)[-1])  # the last group may go on
            if cut:
                fp = ints(held, "fp")[:cut].view(np.uint64)
                coords = held.column("coords").slice(0, cut).flatten().to_numpy(zero_copy_only=False)
                x, y = _near(fp, coords.reshape(cut, n_pivots), group[:cut], bits)
                yield pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64)), pa.array(fp[y].view(np.int64))],
                                                 ["a", "b"])
            held = held.slice(cut) if cut < n else None

    return (dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                    bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, text_key.

    Words are runs without ASCII white space, A-Z lower-cased; null, empty and blank texts
    have fingerprint zero and link like any other. Repeated rows and equal texts share a
    fingerprint and so a component; ``component_id`` is the smallest id in it (null where all
    its ids are null). A fingerprint that a third of the rows share is one row of the link
    search. Very long texts are hashed in pieces. An empty table gives no rows.
    """
    prints = settled(fingerprints(docs, id_col, text_col, k), "prints")
    first = settled(prints.groupBy("fp").agg(F.min(real_id()).alias("own")), "first")
    found = settled(components(links(first, bits)), "components")
    least = found.join(first, found.node == first.fp).groupBy("root").agg(F.min("own").alias("component"))
    of = first.join(found.join(least, "root").select(F.col("node").alias("fp"), "component"), "fp", "left")
    # written, so that a fingerprint of many rows meets it in a plain join, which Spark can split
    of = settled(of.select("fp", F.coalesce("component", "own").alias("component_id")), "components")
    return prints.join(of, "fp").select(
        real_id().alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
        F.col("th").alias("text_key"))
