"""Byte-level BPE against tiktoken, token shards against tokenizers, grammar round trips."""
import base64
import hashlib
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_rows import frame, key, rough_rows, rows_of, words
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tonekit.llm import bpe, token_store

ROWS = rough_rows()


@pytest.fixture(scope="module")
def oracle():
    import tiktoken

    with open(bpe.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.load(bpe.vocabulary_path(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(token_store.VOCABULARY))
    t.encode_special_tokens = True
    return t


TEXTS = st.text(st.one_of(st.sampled_from(" \n\t\r  abcdeABzst'.,!0123éñß漢  \u0085 \x1ć"),
                          st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=400, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS)
def test_bpe_is_tiktoken(own, oracle, text):
    ids = own.encode_batch([text])[0]
    assert ids == oracle.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"in", b"the", b" ", b"er", b"\xc3", b"z9"]), min_size=1, max_size=80))
def test_matrix_and_heap_agree(parts):
    own = bpe.load(bpe.vocabulary_path(), public_tokenizers.PATTERN)
    piece = b"".join(parts)
    matrix = own.merge_matrix(own.byte[np.frombuffer(piece, np.uint8)][None, :].copy())[0]
    assert matrix.tolist() == own.merge_long(piece)


def test_bpe_query_rows(rough, oracle):
    sha = hashlib.sha256
    want = []
    for i, t in ROWS:
        ids = oracle.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()).hexdigest(), sha((t or "").encode()).hexdigest()))
    assert rows_of(bpe.encode(rough), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=key)


def test_long_piece(own, oracle):
    text = "x" * 40000 + words(5, 1) * 3000
    assert own.encode_batch([text])[0] == oracle.encode_ordinary(text)


def peak_of(work) -> float:
    """Megabytes that ``work()`` has at once."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_batch_is_held_as_numbers(own):
    texts = [words(400, i) for i in range(700)]
    assert sum(map(len, texts)) == 1_590_247
    own.encode_batch(texts)  # its words are known from here on
    assert peak_of(lambda: own.encode_batch(texts)) < 12  # 20.8 with a string for every word, 8.2 without


def test_pieces_are_merged_in_small_matrices(own):
    letters = np.random.default_rng(3).integers(97, 123, (10_000, 60), np.uint8)
    pieces = [x.tobytes() for x in letters]
    got = []
    assert peak_of(lambda: got.extend(own.merge(pieces))) < 20  # 37.0 in matrices of 16,384 rows, 10.6 without
    assert [list(x) for x in got[::500]] == [own.merge_long(p) for p in pieces[::500]]


def test_a_worker_forgets_units_and_goes_on(oracle, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 50)
    own = bpe.Bpe(bpe.vocabulary_path(), public_tokenizers.PATTERN)
    for i in range(6):
        texts = [words(40, i), "", f"a  {words(3, i)}\n", words(40, i + 1)]
        assert own.encode_batch(texts) == [oracle.encode_ordinary(t) for t in texts]
        assert len(own.known) == len(own.numbers) < 200


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS)
def test_chunks_are_the_library(library, text):
    enc = token_store.encoder(public_tokenizers.path(token_store.VOCABULARY))
    ids, counts = enc.batch([text, "", text])
    want = library.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == [*want, 1, 1, *want, 1] and counts.tolist() == [len(want) + 1, 1, len(want) + 1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "|>", " ", "\n", "\x1c",
                                 "one", "e", "\u0301", "É", "don't", "漢", "7"]), max_size=12).map("".join))
def test_added_tokens_are_the_library(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_store.VOCABULARY)
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    ids, counts = token_store.encoder(path).batch([text, text])
    assert ids.tolist() == [*want, 1, *want, 1] and counts.tolist() == [len(want) + 1] * 2


def test_added_tokens_in_the_store(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_store.VOCABULARY))
    texts = ["one <|endoftext|> two", "a<|startoftext|>B<|endoftext|><|endoftext|>c", "plain"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [637, 49407, 1237]
    got = rows_of(token_store.token_table(frame(spark, list(enumerate(texts)))), "doc_id", "ids")
    assert [list(ids)[:len(w)] for (_, ids), w in zip(got, want)] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=400), st.integers(0, 400), st.integers(0, 400))
def test_grammar_round_trip(ids, a, b):
    ids = np.array(ids * 4, np.int64)
    rules, lengths, symbols = token_store.compress(ids, 10, least=4)
    assert token_store.expand(symbols, rules, lengths, 10).tolist() == ids.tolist()
    a, b = sorted((min(a, len(ids)), min(b, len(ids))))
    if len(ids):
        assert token_store.read_range(symbols, rules, lengths, 10, a, b).tolist() == ids[a:b].tolist()


def test_grammar_compresses():
    ids = np.tile(np.arange(50), 200)
    rules, lengths, symbols = token_store.compress(ids, 100)
    assert len(symbols) < len(ids) / 20 and len(rules) and lengths.max() > 20


def test_token_table(rough, library):
    docs = rough.filter("doc_id is not null and doc_id not in (15)")
    rows = sorted((r for r in ROWS if r[0] is not None and r[0] != 15), key=lambda r: r[0])
    want, start = [], 0
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert rows_of(token_store.token_table(docs), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert token_store.token_table(rough).count() == len(ROWS)


def test_one_document_from_a_shard(spark, library):
    texts = [words(i, 80) + " over and over " * 40 for i in range(30)]
    shards = token_store.write_shards(frame(spark, list(enumerate(texts)), clash=False).coalesce(1)).collect()
    r = shards[0]
    counts = np.frombuffer(r["counts"], "<i8")
    begin = int(counts[:1].sum())
    ids = token_store.read_range(np.frombuffer(r["symbols"], "<u2"), np.frombuffer(r["rules"], "<u2").reshape(-1, 2),
                                 np.frombuffer(r["lengths"], "<i8"), r["base"], begin, begin + int(counts[1]))
    first = int(np.frombuffer(r["dids"], "<i8")[1])
    assert ids.tolist() == [*library.encode(texts[first], add_special_tokens=False).ids, 1]


def test_empty_tables(nothing):
    assert bpe.encode(nothing).count() == 0
    assert token_store.token_table(nothing).count() == 0


def test_whole_table(spark, oracle, library):
    import duckdb

    from tonekit.llm import queries as Q

    root = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"select doc_id, text from '{root}/documents.parquet' order by 1").fetchall()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in Q.op3_byte_bpe(spark, root).collect()}
    start, tokens = 0, {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in Q.op8_token_store(spark, root).collect()}
    assert len(got) == len(tokens) == len(docs)
    for i, t in docs:
        ids = oracle.encode_ordinary(t)
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert tokens[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["Word", "ÉCOLE", "éa", "ſ", "İx", "ß", "don", "'s", "'", "’s", "...", "$$$", "!!", ",", "_", "-", "7", "漢",
                                 " ", "\n", "Ω", "ͅ", "ǅ", "ŉ"]), max_size=14).map("".join))
def test_words_and_marks_are_the_library(library, text):
    enc = token_store.encoder(public_tokenizers.path(token_store.VOCABULARY))
    want = library.encode(text, add_special_tokens=False).ids
    ids, counts = enc.batch([text, text])
    assert ids.tolist() == [*want, 1, *want, 1] and counts.tolist() == [len(want) + 1] * 2


def test_frequent_chunks_are_kept_when_others_are_forgotten(monkeypatch, library):
    monkeypatch.setattr(token_store, "REMEMBER", 60)
    monkeypatch.setattr(token_store, "TOGETHER", 7)
    enc = token_store.Encoder(public_tokenizers.path(token_store.VOCABULARY))
    for i in range(12):
        texts = [f"often and often again {words(i, 30)}, {words(i + 100, 3)}!!", "", words(i % 3, 8)]
        ids, counts = enc.batch(texts)
        want = [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
        assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]
        if i > 3:
            assert "often" in enc.chunks.code and len(enc.chunks) < 60 + 50


def test_batches_are_gathered():
    import pyarrow as pa

    texts = ["x" * n for n in (5, 3, 0, 40, 2, 2, 2, 9)]
    rows = pa.table({"did": list(range(8)), "text": texts}).to_batches(max_chunksize=2)
    got = [[t for t in b.column("text").to_pylist()] for b in token_store.gathered(rows, 10)]
    assert [t for b in got for t in b] == texts and all(len(b) == 1 or sum(map(len, b)) <= 20 for b in got) and len(got) < 6
    assert list(token_store.gathered(iter([]), 10)) == []
