"""Fill-in-the-middle transformation of whole documents.

A text is a run of units (lines by default). One ``fullmatch`` of ``(unit)*`` with the regex
library, which keeps every repetition of a group, gives the end of each unit as
``match.ends(1)``: their number is n, and the two cuts are looked up in them. Which documents
are rearranged, how, and where they are cut follows from a hash of the id, so a retried task
or another partitioning gives the same rows.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, keyed, real_id, sized_batches

#: A line with its line feed, or the rest of a text that ends without one.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Characters that one fullmatch takes. The regex library keeps some four million repetitions
#: at most and then raises MemoryError, so a longer text is matched in pieces that end at a
#: line feed, where a unit ends anyway.
PIECE = 1 << 20
BATCH_BYTES = 1 << 20


def pieces(text: str, size: int = PIECE):
    """(start, end) of parts of about ``size`` characters, each but the last ending at a line feed."""
    a = 0
    while a < len(text):
        b = len(text)
        if b - a > size:
            b = text.find("\n", a + size - 1) + 1 or b
        yield a, b
        a = b


def unit_ends(repeated, text: str) -> np.ndarray:
    """End of every unit of ``text``; ``repeated`` is the compiled ``(unit)*``."""
    if len(text) <= PIECE:
        return np.array(repeated.fullmatch(text).ends(1), np.int64)
    return np.concatenate([np.array(repeated.fullmatch(text, a, b).ends(1), np.int64) for a, b in pieces(text)])


def draws(seed: int, did: int) -> list[int]:
    """The first four 8-digit groups of the hex SHA-256 of ``seed:id`` (a null id has no digits)."""
    h = hashlib.sha256(f"{seed}:{'' if did == NULL_ID else did}".encode()).digest()
    return [int.from_bytes(h[i:i + 4], "big") for i in (0, 4, 8, 12)]


def rearranged(repeated, text: str, did: int, seed: int, rate: int, spm_rate: int):
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = unit_ends(repeated, text)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, did)
    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a = int(ends[first - 1]) if first else 0
    b = int(ends[second - 1]) if second else 0
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, unit: str = LINES,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars, output.

    ``rate`` per cent of the documents are rearranged, ``spm_rate`` per cent of those suffix
    first. Null texts count as empty; empty texts and texts that hold a marker stay plain, with
    null prefix_chars and middle_chars. Rows are taken one by one, so repeated rows give equal
    rows; a null id is drawn like an id without digits. ``unit`` must cover every text and end
    a unit at each line feed (long texts are matched in pieces cut there). No shuffle; a task
    holds one batch of texts. Other columns are not read. An empty table gives no rows.
    """
    def run(batches):
        import regex

        repeated = regex.compile(f"({unit})*")
        for b in sized_batches(batches, BATCH_BYTES):
            rows = [rearranged(repeated, t, i, seed, rate, spm_rate)
                    for i, t in zip(b.column("did").to_pylist(), b.column("text").to_pylist())]
            n, form, prefix, middle, output = zip(*rows)
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("did"), "n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()),
                "prefix_chars": pa.array(prefix, pa.int64()), "middle_chars": pa.array(middle, pa.int64()),
                "output": pa.array(output, pa.string())})

    out = keyed(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumn("doc_id", real_id("doc_id"))


def restored(form: str | Column = "form", output: str | Column = "output") -> Column:
    """The text as it was, from form and output alone. A rearranged text holds no marker, so
    the first of each marker in the output is the one that was put there."""
    out = F.col(output) if isinstance(output, str) else output
    kind = F.col(form) if isinstance(form, str) else form
    p, s, m = (F.instr(out, F.lit(x)) for x in (PREFIX, SUFFIX, MIDDLE))
    k = len(PREFIX)

    def part(marker: Column, end: Column | None) -> Column:
        return F.substring(out, marker + k, F.length(out) if end is None else end - marker - k)

    return (F.when(kind == "psm", F.concat(part(p, s), part(m, None), part(s, m)))
            .when(kind == "spm", F.concat(part(p, m), part(m, None), part(s, p))).otherwise(out))
