"""Personal data, fill-in-the-middle and source divergence against brute force."""
import hashlib
import random
import re
from collections import Counter

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import CLASHES, frame, key, rough_rows, rows_of
from pyspark.sql import functions as F

from tonekit.llm import divergence, fim, pii
from tonekit.llm import queries as Q

ROWS = rough_rows()
SF = "/root/testdata/sf0.001"

# -- personal data -------------------------------------------------------------------------------
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute_base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = "".join(re.findall("[0-9]", m[0]))
            ok = {"email": True, "ip": kind == "ip" and all(int(x[-300:]) <= 255 and not x[:-300].strip("0") for x in m[0].split(".")),
                  "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), list(PATTERNS).index(kind), m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def own_base(text):
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _, base in pii.spans(text) if base)


PERSONAL = st.text(st.sampled_from(list("aZ09._%+-@ ()\n:éß") + ["1.2.3.4", "255", "256", "+1 (663) 555-6869", "4242 4242 4242 4242",
                                                         "a.b@c.d", "@x.y", "4716-1867-2206-0932"]).map(str), max_size=30)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(list("aZ0159._%+-@ ()\n:éß") + ["1.2.3.4", "255", "256", "000", "+1 (663) 555-6869", "4242 4242 4242 4242",
                                                          "a.b@c.d", "@x.y", "4716-1867-2206-0932", "١٢"]), max_size=30).map("".join))
def test_base_spans_are_the_contracts(text):
    assert own_base(text) == brute_base(text)


def test_base_spans_of_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "1 " * 150_000, "a.b@c." * 50_000,
              "(1" * 150_000, "AB12" * 75_000, "a (at) " * 40_000, "0" * 10_000 + ".1.2.3", "+1" + " " * 300_000):
        pii.spans(t)
    assert own_base("0" * 10_000 + "7.1.2.3") == "ip:0:10007"


def own_added(text):
    return [(k, text[a:b]) for k, a, b, _, base in pii.spans(text) if not base]


def test_checksums_and_context_decide_on_added_spans():
    assert own_added("IBAN: GB82 WEST 1234 5698 7654 32 AND MORE") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert own_added("pay to DE89370400440532013000.") == [("iban", "DE89370400440532013000")]
    assert own_added("pay to DE89370400440532013001.") == []  # mod-97
    assert own_added("pay to DE8937040044053201300 now") == []  # length
    assert own_added("XDE89370400440532013000 DE89370400440532013000X") == []
    assert own_added("social security 078-05-1120") == [("ssn", "078-05-1120")]
    assert own_added("row 078-05-1120 of the table") == []
    assert own_added("social security 000-05-1120, 666-05-1120, 900-05-1120, 078-00-1120, 078-05-0000") == []
    assert own_added("Tel. 030 1234 5678!") == [("tel", "030 1234 5678")]
    assert own_added("in 030 1234 5678 rows") == [] and own_added("call +49 030 1234 5678 9") == []
    assert own_added("order no, call 030 1234 5678") == []  # a word for and a word against
    assert own_added("write jane.doe (at) example (dot) com or me") == [("mail_at", "jane.doe (at) example (dot) com")]
    assert own_added("e-mail: a [at] b.org") == [("mail_at", "a [at] b.org")]


def test_scores():
    def first(text):
        return pii.spans(text)[0][3]

    assert first("card 4242424242424242") > first("4242424242424242") > first("order 4242424242424242")
    assert first("10.0.0.1") > first("version 10.0.0.1")
    assert all(0 <= s[3] <= 1 for s in pii.spans("mail a@b.c card 4242424242424242 +1 663 555 6869 ip 1.2.3.4"))


def test_added_spans_give_way_only_to_what_they_touch():
    t = "call 030 1234 5678 or +1 (663) 555-6869 or 040 1234 567"
    assert [(k, t[a:b]) for k, a, b, _, _ in pii.spans(t)] == [
        ("tel", "030 1234 5678"), ("phone", "+1 (663) 555-6869"), ("tel", "040 1234 567")]


PRIVATE = ROWS + [
    (30, "😀 mail a.b@c.de and 8.196.197.208, card 4242 4242 4242 4242, +1 (663) 555-6869"), (31, "a@b.c@d.e 1.2.3.4.5.6.7.8"),
    (32, "é@b.c ä+1@b.c " * 50), (33, "call 030 1234 5678"), (33, "call 030 1234 5678"), (34, "4242424242424242" * 2000),
]


def test_pii_of_rough_rows(spark):
    docs = frame(spark, PRIVATE)
    got = docs.transform(pii.find).select("doc_id", *[pii.count(k).alias(k) for k in pii.BASE], pii.listed("s.base").alias("b"),
                                          pii.listed().alias("all"))
    want = []
    for i, t in PRIVATE:
        b = brute_base(t or "")
        kinds = Counter(x.split(":")[0] for x in b.split(",") if x)
        want.append((i, *[kinds[k] for k in pii.BASE], b, ",".join(f"{k}:{a}:{e}" for k, a, e, _, _ in pii.spans(t or ""))))
    assert rows_of(got, *got.columns) == sorted(want, key=key)
    assert any(w[5] != w[6] for w in want)


def test_pii_query_is_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q.op11_pii(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        b = brute_base(docs[r.doc_id])
        kinds = Counter(x.split(":")[0] for x in b.split(",") if x)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in pii.BASE)
        assert r.base_sha256 == hashlib.sha256(b.encode()).hexdigest()
        assert set(filter(None, b.split(","))) <= set(r.spans.split(","))


def test_pii_masks(spark):
    docs = frame(spark, [(1, "to a@b.cc, +1 (663) 555-6869."), (2, None), (3, "clean")])
    assert rows_of(pii.masked(docs), "doc_id", "text") == [(1, "to <EMAIL>, <PHONE>."), (2, ""), (3, "clean")]


# -- fill in the middle --------------------------------------------------------------------------
def brute_fim(i, text):
    text = text or ""
    units = [u + "\n" for u in text.split("\n")[:-1]] + [x for x in text.split("\n")[-1:] if x]
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return i, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


LINED = ROWS + [(40 + i, t) for i, t in enumerate([
    "a\n\nb", "\n", "\n\n\n", "x\r\ny z\x85w\x0b\n", "has <S> in it\nmore", "<P", "<\n<S\n<M\n", "é😀\n" * 40, "a<\nP>", "l\n" * 3000])]


def test_fim_of_rough_rows(spark):
    docs = frame(spark, LINED)
    out = fim.transform(docs)
    got = rows_of(out, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    assert got == sorted((brute_fim(i, t) for i, t in LINED), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = rows_of(out.select("doc_id", fim.restored().alias("t")), "doc_id", "t")
    assert back == sorted(((i, t or "") for i, t in LINED), key=key)


def test_fim_rates(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc").alias("text"))
    n = {r.form: r["count"] for r in fim.transform(docs, rate=30, spm_rate=20).groupBy("form").count().collect()}
    assert 450 < n["psm"] + n["spm"] < 750 and 50 < n["spm"] < 200


def test_fim_matches_long_texts_in_pieces(monkeypatch):
    repeated = regex.compile(f"({fim.LINES})*")
    texts = ["ab\n" * 50, "\n" * 33, "x" * 100, "x" * 100 + "\ny", "a\n" + "b" * 70 + "\n\n\nc", ""]
    whole = [fim.unit_ends(repeated, t).tolist() for t in texts]
    for size in (1, 2, 7, 16):
        monkeypatch.setattr(fim, "PIECE", size)
        monkeypatch.setattr(fim.pieces, "__defaults__", (size,))
        assert [fim.unit_ends(repeated, t).tolist() for t in texts] == whole


def test_fim_takes_more_units_than_one_match_can():
    ends = fim.unit_ends(regex.compile(f"({fim.LINES})*"), "\n" * 6_000_000)
    assert len(ends) == 6_000_000 and ends[-1] == 6_000_000


# -- divergence ----------------------------------------------------------------------------------
def brute_audit(rows, min_docs, top=50):
    """rows: (lang, source, text)."""
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
            for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= min_docs]
        counts = {}
        for la, so, w in docs:
            if la == lang:
                counts.setdefault(so, Counter()).update(t for t in w if t in set(kept))

        def p(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        q = sum(counts.values(), Counter())
        for so, c in counts.items():
            pair = [(sum(abs(p(c, t) - p(o, t)) for t in kept), h) for h, o in counts.items() if h != so]
            term = [(p(c, t) - p(q, t), t) for t in kept if c[t] and p(c, t) > p(q, t)]
            for part, found in (("pair", pair), ("term", term)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, so, part, t, v, i + 1) for i, (v, t) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def audit_rows():
    r = random.Random(5)
    vocabulary = ["the", "The", "of", "naïve", "東京", "ÉCOLE", "don", "x", "zeta", "rare"] + [f"w{chr(97 + i)}" for i in range(12)]
    rows = []
    for i in range(400):
        source = "hot" if i % 3 else f"s{r.randrange(7)}"
        text = " ".join(r.choices(vocabulary, weights=[9, 2, 5, 1, 1, 1, 2, 1, 0.2, 0.05] + [r.random() for _ in range(12)], k=r.randrange(25)))
        rows.append((r.choice(["en", "en", "de", None]), source, text.replace(" x ", "-x'")))
    return rows + [("en", None, None), ("en", "", ""), ("solo", "only", "the the"), ("none", "a", None), ("none", "b", "once"), ("none", "c", "!"),
                   ("en", "s1", "same row"), ("en", "s1", "same row"), ("en", "long", "w" * 5000 + " the" * 5000)]


def audit_frame(spark, rows, parts=5):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    for c in CLASHES + ["term", "g", "p", "total", "item", "value", "rank", "part"]:
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(parts)


COLS = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("block, pairs, step", [(250_000, 2_000_000, 1 << 20), (7, 11, 3)])
def test_audit_is_brute_force(spark, monkeypatch, block, pairs, step):
    for name, v in (("BLOCK", block), ("PAIRS", pairs), ("STEP", step)):
        monkeypatch.setattr(divergence, name, v)
    rows = audit_rows()
    got = divergence.audit(audit_frame(spark, rows), min_docs=4, top=6)
    assert rows_of(got, *COLS) == brute_audit(rows, 4, 6)


def test_audit_gives_counters_out_when_many(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "PIECE", 16)
    rows = audit_rows()[:120]
    got = divergence.audit(audit_frame(spark, rows, 2), min_docs=3)
    assert rows_of(got, *COLS) == brute_audit(rows, 3)


def test_terms_in_pieces(monkeypatch):
    texts = ["", "one", "One two  three", "aé-東京x" * 9, "w" * 40 + " x", "a " * 30, "x" + "w" * 40, " " * 40]
    whole = [[t for part in divergence.terms_of(t.encode()) for t in part] for t in texts]
    for size in (1, 2, 3, 5, 17):
        monkeypatch.setattr(divergence, "PIECE", size)
        assert [[t for part in divergence.terms_of(t.encode()) for t in part] for t in texts] == whole


def test_audit_of_nothing(spark, nothing):
    assert divergence.audit(nothing).collect() == []
    assert pii.find(nothing).collect() == [] and fim.transform(nothing).collect() == []


def test_shares_are_exact_beyond_doubles(spark):
    big = 9_007_199_254_740_993
    got = spark.sql(f"select {big}L as n, {3 * big}L as total, 7L as terms").select(divergence.share("n", "total", "terms")).first()[0]
    assert got == 1 + 10**9 * (big + 5) // (3 * big + 35)
