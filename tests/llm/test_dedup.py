"""Exact, near, substring and sentence deduplication against brute force."""
import hashlib
import re

import numpy as np
import pytest
from llm_rows import frame, key, rough_rows, rows_of, words

from tonekit.llm import exact_dedup, sentence_spans, simhash, substring
from tonekit.llm.common import components, later_copies, without

ROWS = rough_rows()


def plain(rows):
    """Rows in the order in which the operators see them: null ids first."""
    return [(-(1 << 63) if i is None else i, t) for i, t in rows]


def distinct(rows):
    return list(dict.fromkeys(plain(rows)))


def test_exact_groups(rough):
    def norm(t):
        return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")

    want = []
    for i, t in ROWS:
        group = [j for j, u in ROWS if norm(u) == norm(t)]
        ids = [j for j in group if j is not None]
        keep = min(ids) if ids else None
        want.append((i, keep if len(group) > 1 else i, len(group), (keep if len(group) > 1 else i) == i,
                     hashlib.sha256(norm(t).encode()).hexdigest()))
    got = rows_of(exact_dedup.exact_dedup(rough), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(want, key=key)


def test_exact_is_native(rough):
    plan = exact_dedup.exact_dedup(rough)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_exact_prefix_and_length_alone_do_not_group(spark):
    same = "x" * 400
    docs = frame(spark, [(1, same + "a"), (2, same + "b"), (3, same + "a"), (4, "y" * 401)])
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)}


def brute_simhash(rows, bits=4):
    fp = np.array([simhash.fingerprint(t or "") for _, t in rows], np.uint64)
    up = list(range(len(rows)))

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in range(len(rows)):
        for b in range(a):
            if int(fp[a] ^ fp[b]).bit_count() <= bits:
                up[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for x, (i, _) in enumerate(rows):
        groups.setdefault(root(x), []).append(i)
    least = {r: min((i for i in g if i is not None), default=None) for r, g in groups.items()}
    return sorted(((i, f"{int(fp[x]):016x}", least[root(x)]) for x, (i, _) in enumerate(rows)), key=key)


def test_simhash_components(rough):
    got = rows_of(simhash.near_duplicates(rough), "doc_id", "fingerprint", "component_id")
    assert got == brute_simhash(ROWS)


def test_fingerprint_by_definition():
    import xxhash

    text = "The Quick brown fox\tjumps over THE the lazy dog"
    w = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]), 42) for i in range(len(w) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("") == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("Two words") == xxhash.xxh64_intdigest("two words", 42)


@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_links_join_all_near_fingerprints(spark, monkeypatch, blocks):
    """Chains and dense groups, buckets larger than a chunk, any number of blocks."""
    rng = np.random.default_rng(blocks)
    fps = list(rng.integers(0, 2 ** 63, 60, dtype=np.uint64))
    for f in fps[:20]:
        for _ in range(12):
            g = int(fps[-1] if rng.random() < .3 else f)
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                g ^= 1 << int(b)
            fps.append(np.uint64(g))
    fps = np.unique(np.array(fps, np.uint64))
    monkeypatch.setattr(simhash, "_blocks", lambda n, bits: blocks)
    monkeypatch.setattr(simhash, "CHUNK", 8)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r.node: r.root for r in components(simhash.links(df, 4)).collect()}
    up = list(range(len(fps)))

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in range(len(fps)):
        for b in np.flatnonzero(np.bitwise_count(fps[:a] ^ fps[a]) <= 4):
            up[max(root(a), root(int(b)))] = min(root(a), root(int(b)))
    sets = {}
    for x in range(len(fps)):
        f = int(fps.view(np.int64)[x])
        sets.setdefault(root(x), set()).add(found.get(f, f))
    assert all(len(s) == 1 for s in sets.values())
    assert len(set.union(*sets.values())) == len(sets)


def test_components_of_a_path(spark):
    n = 300
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(e).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_substring_removal(rough):
    rows = distinct(ROWS)
    # rows with one id and different texts are ordered by text hash: leave the second of them out
    rows = [r for r in rows if r[0] != 15]
    docs = rough.filter("not (doc_id <=> 15)").filter("doc_id is not null")
    rows = [r for r in rows if r[0] >= 0]
    want = substring.brute_force(rows)
    got = rows_of(substring.remove_repeats(docs).distinct(), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == want
    assert substring.remove_repeats(docs).count() == len([i for i, _ in ROWS if i is not None and i != 15])


def test_substring_over_pieces_and_batches(spark, monkeypatch):
    monkeypatch.setattr(substring, "PIECE", 512)
    monkeypatch.setattr(substring, "BATCH_BYTES", 4000)
    a, b, c = words(11, 700), words(12, 500), words(13, 40)
    rows = [(i, t) for i, t in enumerate([a, b, a[1000:3000], b + c + a[:400], c, c + c, "ab" * 900, a, "q" * 99, b[77:],
                                          *[words(100 + i, 30) + c + words(200 + i, 30) for i in range(30)]])]
    got = rows_of(substring.remove_repeats(frame(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == substring.brute_force(rows)


def test_sentence_spans(rough):
    docs = rough.filter("doc_id is not null and doc_id <> 15")
    rows = [r for r in distinct(ROWS) if r[0] >= 0 and r[0] != 15]
    got = sorted({(r.doc_id, r.n_sentences, tuple(r.removed))
                  for r in sentence_spans.remove_repeated_sentences(docs).collect()})
    assert got == [(i, n, tuple(g)) for i, n, g in sentence_spans.brute_force(rows)]


def test_sentence_passage_goes_and_clean_text_stays(spark):
    passage = ". ".join(words(40 + i, 9).capitalize() for i in range(7)) + "."
    rows = [(i, words(60 + i, 25).capitalize() + ". " + (passage if i % 2 else "The. And. Of. To.") + "\n"
             + words(80 + i, 25) + ".") for i in range(6)]
    out = {r.doc_id: r for r in sentence_spans.remove_repeated_sentences(frame(spark, rows)).collect()}
    assert passage in out[1].kept_text
    for i in (3, 5):
        assert passage[:40] not in out[i].kept_text and words(60 + i, 25).capitalize()[:30] in out[i].kept_text
        assert words(80 + i, 25)[:30] in out[i].kept_text
    assert all(out[i].n_removed == 0 and out[i].kept_text == rows[i][1] for i in (0, 2, 4))


def test_sentence_cuts_move_with_the_passage():
    """Every passage of 50 words that two texts without stops share has a run in both, at any offset."""
    passage = words(90, 50)
    for k in range(40):
        a, b = words(300 + k, k), words(400 + k, 7 + k % 5)
        one, two = f"{b} {passage} {a}".strip(), f"{a} {passage} {b}".strip()
        split = one.split(), two.split()
        assert {tuple(split[0][i:i + 50]) for i in range(len(split[0]) - 49)} & {
            tuple(split[1][i:i + 50]) for i in range(len(split[1]) - 49)}
        got = sentence_spans.brute_force([(1, one), (2, two)])
        assert got[0][2] == [] and got[1][2], k
        w = [n for _, _, n in sentence_spans.sentences(two)]
        assert max(w[1:-1]) <= sentence_spans.WINDOW and sum(w) == len(split[1])


def test_sentence_passage_behind_other_words_goes(spark):
    passage = words(91, 400)
    rows = [(1, passage), (2, words(92, 3) + " " + passage), (3, words(93, 37) + " " + passage + " " + words(94, 30))]
    out = {r.doc_id: r for r in sentence_spans.remove_repeated_sentences(frame(spark, rows)).collect()}
    assert out[1].n_removed == 0 and out[1].kept_text == passage
    middle = " ".join(passage.split()[20:380])
    for i in (2, 3):
        assert len(set(out[i].kept_text.split()) & set(middle.split())) < 40
    assert out[3].kept_text.startswith(words(93, 20)) and out[3].kept_text.endswith(words(94, 30)[-20:])


def wide(seed: int, n: int, first: int = 0x4e00, last: int = 0x9f00) -> str:
    return "".join(map(chr, np.random.default_rng(seed).integers(first, last, n)))


def test_sentences_without_blanks(spark):
    chinese = "。".join(wide(i, 9 + i) for i in range(12)) + "。"
    japanese = "".join(f"「{wide(30 + i, 8, 0x3041, 0x3096)}！」" for i in range(6))
    thai = wide(50, 300, 0x0e01, 0x0e2e)
    rows = [(1, chinese), (2, chinese), (3, wide(60, 7) + "。" + chinese), (4, japanese), (5, japanese + "終"), (6, thai),
            (7, wide(61, 5, 0x0e01, 0x0e2e) + thai), (8, "。".join(wide(70 + i, 20) for i in range(9)))]
    out = {r.doc_id: r for r in sentence_spans.remove_repeated_sentences(frame(spark, rows)).collect()}
    assert out[1].n_removed == out[4].n_removed == out[6].n_removed == out[8].n_removed == 0
    assert all(out[i].kept_text == rows[i - 1][1] for i in (1, 4, 6, 8))
    assert out[2].kept_text == "" and out[2].n_removed == out[2].n_sentences >= 12
    assert out[3].kept_text == rows[2][1][:8] and out[5].kept_text == "終" and len(out[7].kept_text) < 40
    assert [(r.doc_id, r.n_sentences, list(r.removed)) for _, r in sorted(out.items())] == sentence_spans.brute_force(rows)


def test_wide_stops_keep_every_character():
    text = "一二三。」 四五六！？七八\n九十。\n「abc。def」 x. y"
    got = sentence_spans.sentences(text)
    assert [text[a:b] for a, b, _ in got] == ["一二三。」 ", "四五六！？", "七八\n", "九十。\n", "「abc。", "def」 x. ", "y"]


def test_later_copies_keeps_first_place(spark):
    rows = spark.createDataFrame([(1, 1, 5, 0), (1, 1, 3, 7), (1, 1, 3, 7), (1, 1, 3, 9), (1, 2, 1, 1), (2, 2, 1, 1)],
                                 "h long, g long, did long, pos long")
    got = rows_of(later_copies(rows, ["h", "g"], ["did", "pos"]), "did", "pos")
    assert got == [(3, 9), (5, 0)]


def test_without_keeps_columns_and_null_ids(spark, rough):
    drop = spark.createDataFrame([], "did long, th long")
    out = without(rough, drop)
    assert out.columns == rough.columns and out.count() == len(ROWS)


def test_empty_tables(nothing):
    for f in (exact_dedup.exact_dedup, simhash.near_duplicates, substring.remove_repeats,
              sentence_spans.remove_repeated_sentences):
        assert f(nothing).count() == 0


def test_whole_table_against_brute_force(spark):
    import duckdb

    from tonekit.llm import queries as Q

    root = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"select doc_id, text from '{root}/documents.parquet' order by 1").fetchall()
    got = rows_of(Q.op2_substring_dedup(spark, root), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == substring.brute_force(docs)
    got = rows_of(Q.op7_simhash(spark, root), "doc_id", "fingerprint", "component_id")
    assert got == brute_simhash(docs)
    got = [(i, n, list(g)) for i, n, g in rows_of(Q.op6_sentence_dedup(spark, root), "doc_id", "n_sentences", "removed")]
    assert got == sentence_spans.brute_force(docs)


def test_pieces_are_the_sentences():
    texts = [t for _, t in ROWS if t] + ["", " \n ", "a. b! c?  d\n\ne " + "w " * 40 + "end. x", "第一句。第二句！ third one. " * 9,
                                         "x\x1cy\x85z. q\xa0r.\n s" * 12, ". . . a.b", "one.\r\n\r\ntwo"]
    for t in texts:
        got = list(sentence_spans._pieces(t))
        assert [p[:3] for p in got] == sentence_spans.sentences(t)
        assert [p[3] for p in got] == [" ".join(t[a:b].split()) for a, b, _ in sentence_spans.sentences(t)]


def test_run_hashes_follow_the_sentences_alone():
    r = np.random.default_rng(1)
    part = r.integers(0, 2**64, (9, 2), dtype=np.uint64)
    rows = np.concatenate([part, r.integers(0, 2**64, (5, 2), dtype=np.uint64), part, part[::-1]])
    first = np.array([0, 14, 23, 0, 0, 14])
    h, g = sentence_spans._run_hashes(rows, first, np.array([9, 23, 32, 8, 3, 17]))
    assert h[0] == h[1] and g[0] == g[1] and h[4] == h[5] and g[4] == g[5]
    assert len({(a, b) for a, b in zip(h.tolist(), g.tolist())}) == 4  # order and number count
    zero = np.zeros((4, 2), np.uint64)
    assert len(set(sentence_spans._run_hashes(zero, np.array([0, 0, 0]), np.array([1, 2, 3]))[0].tolist())) == 3


def test_suffix_ranks_are_the_sorted_suffixes():
    r = np.random.default_rng(2)
    for length in (1, 3, 8, 9, 16, 37, 100):
        for raw in (r.integers(0, 2, 400).astype(np.uint8), np.tile(r.integers(0, 256, 90).astype(np.uint8), 5),
                    np.zeros(length, np.uint8), np.zeros(length - 1, np.uint8)):
            b = raw.tobytes()
            pre = [b[i:i + length] for i in range(len(b) - length + 1)]
            rank = {p: k for k, p in enumerate(sorted(set(pre)))}
            assert substring.suffix_ranks(raw, length).tolist() == [rank[p] for p in pre]
