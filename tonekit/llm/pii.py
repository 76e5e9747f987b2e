"""Personal data in documents: proposed by patterns, confirmed by checks, weighed by context.

Four base kinds (e-mail, IP address, payment card, international phone number) are spans that a
pattern proposes and a check of the match confirms (parts of an address, Luhn sum, number of
digits). Further kinds need more than a pattern: an IBAN its country's length and mod-97, a
social security number or a national phone number a word nearby that says what it is, an
e-mail written with ``(at)`` its whole form. Each span has a score: what the check of its kind
is worth, plus or minus what the words around it say. Base spans always stay; added ones stay
if their score reaches ``THRESHOLD`` and they touch no base span.

Every pattern here takes time linear in the text: a scan never starts again inside a run that
has failed from its beginning.
"""
from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, real_id, sized_batches

#: Kinds in the order in which spans with one start are listed.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "tel", "mail_at")
ORDER = {k: i for i, k in enumerate(BASE + ADDED)}

THRESHOLD = 0.5
#: Characters before and after a span in which words count.
BEFORE, AFTER = 48, 24
BATCH_BYTES = 1 << 20

# FIXED VALUES: number of characters of an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "KW": 30, "KZ": 20, "LB": 28,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MT": 31, "NL": 18, "NO": 15,
    "PL": 28, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24,
    "TR": 26, "UA": 29, "XK": 20,
}

#: Worth of a confirmed match before its context is read.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.85, "ssn": 0.3, "tel": 0.3, "mail_at": 0.6}

_ANY = r"\b(?:%s)\b"
#: Words that speak for a kind (English, German, Spanish, French).
FOR = {k: re.compile(_ANY % w) for k, w in {
    "email": r"e-?mail|mail|contact|kontakt|correo|courriel|write to",
    "ip": r"ip|address|adresse|dirección|host|server|serveur|servidor|login|from",
    "card": r"card|karte|tarjeta|carte|visa|mastercard|amex|credit|kredit|cvv|cvc|expir\w*",
    "phone": r"phone|tel|telephone|telefon|teléfono|téléphone|call|fax|mobile|cell|handy|móvil|whatsapp",
    "iban": r"iban|konto|account|cuenta|compte|bank|bic|swift",
    "ssn": r"ssn|social security|soc sec|social",
    "tel": r"phone|tel|telephone|telefon|teléfono|téléphone|call|fax|mobile|cell|handy|móvil|whatsapp",
    "mail_at": r"e-?mail|mail|contact|kontakt|correo|courriel|write",
}.items()}
#: Words that speak against a number being somebody's.
AGAINST = re.compile(_ANY % r"version|release|build|isbn|issn|doi|order|invoice|serial|part no|sku|example|sample|rfc|section")
SAYS_FOR, SAYS_AGAINST = 0.3, -0.25

#: An ``@`` and a domain; the part before the ``@`` is the run of LOCAL that ends there.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The lookbehind allows a start at the first digit of a run only: from inside, a run that failed fails again.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}")
_SSN = re.compile(r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"[0-9(](?<![0-9A-Za-z+().-][0-9(])[0-9]{1,5}+\)?(?:[\x20.-]{1,2}+[0-9]{2,5}+){1,5}+(?![0-9A-Za-z])")
_MAIL_AT = re.compile(r"[A-Za-z0-9._%+-](?<![A-Za-z0-9._%+-][A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{0,63}+\x20?[\[(](?:at|AT)[\])]\x20?"
                      r"[A-Za-z0-9-]++(?:(?:\x20?[\[(](?:dot|DOT)[\])]\x20?|\.)[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(_DOUBLED[x] for x in d[1::2])) % 10 == 0


def mod97(iban: str) -> bool:
    """True if the check digits of an IBAN without blanks hold (letters count from 10)."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def octet(part: str) -> bool:
    """At most 255, whatever zeros stand in front."""
    p = part.lstrip("0")
    return len(p) < 3 or (len(p) == 3 and p <= "255")


def emails(text: str):
    """Leftmost non-overlapping addresses: each ``@`` with a domain takes the run before it."""
    end = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            yield start, end


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text)
                      if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


def _iban_end(text: str, start: int) -> int:
    """End of the IBAN that begins at ``start``, 0 if there is none; single blanks may part its groups."""
    need, at, digits = IBAN_LENGTH.get(text[start:start + 2], 0), start, []
    while len(digits) < need:
        if text[at:at + 1] == " ":
            at += 1
        c = text[at:at + 1]
        if not ("0" <= c <= "9" or "A" <= c <= "Z"):
            return 0
        digits.append(c)
        at += 1
    return at if need and not text[at:at + 1].isalnum() and mod97("".join(digits)) else 0


def proposed(text: str):
    """Spans of the added kinds whose form and checksum hold; context is not read yet."""
    if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
        yield from (("mail_at", *m.span()) for m in _MAIL_AT.finditer(text))
    if not _DIGIT.search(text):
        return
    for m in _IBAN.finditer(text):
        end = _iban_end(text, m.start())
        if end:
            yield "iban", m.start(), end
    for m in _SSN.finditer(text):
        s = m[0]
        if s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000":
            yield "ssn", *m.span()
    for m in _TEL.finditer(text):
        if 7 <= len(_NOT_DIGIT.sub("", m[0])) <= 12:
            yield "tel", *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    """Worth of the kind's check, moved by the words near the span, between 0 and 1."""
    near = text[max(0, start - BEFORE):start].lower() + " \n " + text[end:end + AFTER].lower()
    s = PRIOR[kind] + (SAYS_FOR if FOR[kind].search(near) else 0) + (SAYS_AGAINST if AGAINST.search(near) else 0)
    return round(min(max(s, 0.0), 1.0), 4)


def spans(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) of one text, by start, then kind as listed."""
    base = [(k, a, b, score(text, k, a, b), True) for k, a, b in base_spans(text)]
    taken = sorted((a, b) for _, a, b, _, _ in base)
    out, added = list(base), []
    for k, a, b in proposed(text):
        s = score(text, k, a, b)
        if s >= THRESHOLD:
            added.append((a, k, b, s))
    starts, ends = [], []  # the base spans, merged where they touch
    for a, b in taken:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    last = 0
    for a, k, b, s in sorted(added, key=lambda x: (x[0], ORDER[x[1]], x[2])):
        i = bisect_left(starts, b) - 1  # the last base span that begins before b
        if a >= last and (i < 0 or ends[i] <= a):
            out.append((k, a, b, s, False))
            last = b
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]]))


SPANS = "array<struct<kind: string, start: int, end: int, score: double, base: boolean>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end, score, base) in code points, end exclusive.

    Null and empty texts have no spans. Rows are read one by one: repeated rows give equal rows,
    null ids stay null, other columns are not read. A text of any length is scanned whole in
    linear time. No shuffle; a task holds one batch of texts. An empty table gives no rows.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                               ("score", pa.float64()), ("base", pa.bool_())]))
    names = ("kind", "start", "end", "score", "base")

    def run(batches):
        for b in sized_batches(batches, BATCH_BYTES):
            found = [[dict(zip(names, s)) for s in spans(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("did"), "spans": pa.array(found, span)})

    return keyed(docs, id_col, text_col).mapInArrow(run, f"doc_id long, spans {SPANS}").withColumn(
        "doc_id", real_id("doc_id"))


def count(kind: str) -> Column:
    """Base spans of a kind."""
    return F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{kind}')) as long)")


def listed(where: str = "true") -> Column:
    """kind:start:end of the spans in their order, comma-joined."""
    return F.expr(f"array_join(transform(filter(spans, s -> {where}), "
                  "s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def masked(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text with every span of at least ``threshold`` replaced by ``<KIND>``;
    of overlapping spans the first is replaced and the rest of the others is left out with it."""
    def run(batches):
        for b in sized_batches(batches, BATCH_BYTES):
            out = []
            for t in b.column("text").to_pylist():
                parts, at = [], 0
                for k, s, e, w, _ in spans(t):
                    if w >= threshold and e > at:
                        parts += [t[at:s], f"<{k.upper()}>"] if s >= at else []
                        at = e
                out.append("".join(parts) + t[at:])
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("did"), "text": pa.array(out, pa.string())})

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string").withColumn(
        "doc_id", real_id("doc_id"))
