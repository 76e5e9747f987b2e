"""Text column functions.

Regex notes.  Patterns applied by the reference in Python use Unicode ``\\w``; the
Java engine's ``\\w`` is ASCII, so those patterns spell the word class out as
``[\\p{L}\\p{N}_]``.  Patterns the reference ran in SQL keep ASCII ``\\w``.
Patterns go through ``F.lit`` (never through SQL text), so backslashes are literal.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

UWORD = r"[\p{L}\p{N}_]"  # Unicode word character, as Python's \w


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rx_replace(x, pattern: str, repl: str) -> Column:
    """Replace every match (always global)."""
    return F.regexp_replace(_c(x), F.lit(pattern), F.lit(repl))


def rx_group(x, pattern: str, group: int = 1) -> Column:
    """C14: first match's group, '' when there is no match."""
    return F.regexp_extract(_c(x), pattern, group)


def rx_all(x, pattern: str, group: int = 1) -> Column:
    """Every match's group as an array (explode it for rows)."""
    return F.regexp_extract_all(_c(x), F.lit(pattern), F.lit(group))


def model_input(text, strip: bool = True) -> Column:
    """C17: the normalisation classifiers of tweets were trained with:
    handles -> ``@user``, links -> ``http`` (and optionally trim)."""
    t = rx_replace(text, "@" + UWORD + "+", "@user")
    t = rx_replace(t, K.LINK, "http")
    return F.trim(t) if strip else t


def clean_display_name(name) -> Column:
    """Drop a trailing `` R-TX`` style party/state tag."""
    return rx_replace(name, K.DISPLAY_SUFFIX, "")


def tidy_text(text, max_len: int = K.TIDY_MAX, cut: int = K.TIDY_CUT) -> Column:
    """Drop links, unescape ``&amp;``, one space between words, and when longer
    than ``max_len`` cut to ``cut`` characters at a word edge plus an ellipsis."""
    t = rx_replace(text, K.LINK, "")
    t = F.replace(t, F.lit("&amp;"), F.lit("&"))
    t = F.trim(rx_replace(t, r"\s+", " "))
    short = rx_replace(F.substring(t, 1, cut), r" [^ ]*$", "")
    return F.when(F.length(t) <= max_len, t).otherwise(F.concat(short, F.lit("…")))


def one_line(text, n: int = K.EXAMPLE_CHARS) -> Column:
    """Newlines to spaces, first ``n`` characters."""
    return F.substring(F.replace(_c(text), F.lit("\n"), F.lit(" ")), 1, n)


def _fold_table() -> tuple[str, str, str]:
    """Folding table built by rule: every character outside ASCII whose compatibility
    decomposition (NFKD) keeps an ASCII part -- accented, full-width, styled, circled and
    ligature letters alike.

    Characters that become one letter or blank go straight into ``translate``; those that
    become several are listed in the third string, in code point order. Whatever is not
    listed decomposes to nothing in ASCII and falls to the ``[^a-z ]`` filter."""
    import sys
    import unicodedata

    src, dst, several = [], [], []
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        plain = unicodedata.normalize("NFKD", ch)
        if plain == ch:
            continue
        kept = "".join(c for c in plain.lower() if c == " " or "a" <= c <= "z")
        if len(kept) == 1:
            src.append(ch)
            dst.append(kept)
        elif len(kept) > 1:
            several.append(ch)
    return "".join(src), "".join(dst), "".join(several)


_FOLD_SRC, _FOLD_DST, _FOLD_SEVERAL = _fold_table()


def _several() -> Column:
    """Map of the characters that fold to several letters."""
    import unicodedata

    pairs = []
    for ch in _FOLD_SEVERAL:
        kept = "".join(c for c in unicodedata.normalize("NFKD", ch).lower() if c == " " or "a" <= c <= "z")
        pairs += [F.lit(ch), F.lit(kept)]
    return F.create_map(*pairs)


def fold_ascii(x) -> Column:
    """C20: fold to ASCII (accents, full-width and styled letters, ligatures), lower-case,
    keep ``[a-z ]``, trim -- in the JVM over rule-built tables, no Python worker.

    Letters that fold to several are rare: only texts that hold one are taken apart."""
    t = _c(x)
    many = "[" + _FOLD_SEVERAL + "]"
    spread = F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.try_element_at(_several(), c), c)), "")
    t = F.when(t.rlike(many), spread).otherwise(t)
    t = F.lower(F.translate(t, _FOLD_SRC, _FOLD_DST))
    return F.trim(F.regexp_replace(t, F.lit("[^a-z ]"), F.lit("")))


def tokens(text, pattern: str = K.TOKEN_PATTERN, stop=K.STOP_WORDS) -> Column:
    """Distinct lower-case word and ``#tag`` tokens of a whole message, links and
    handles removed first, stop words dropped (a tag is checked without its ``#``)."""
    t = rx_replace(F.lower(_c(text)), K.LINK + "|@" + UWORD + "+", " ")
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    # a tag is tested without its '#'
    kept = F.filter(found, lambda w: ~F.ltrim(w, F.lit("#")).isin(*sorted(set(stop))))
    return F.array_distinct(kept)


def last_first(name) -> Column:
    """``First Middle Last`` -> ``Last``; used for compact labels."""
    return F.element_at(F.split(F.trim(_c(name)), r"\s+"), -1)


def is_retweet(text) -> Column:
    return _c(text).rlike(K.RETWEET_PREFIX)
