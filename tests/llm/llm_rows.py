"""Rows that the tests of the operators share."""
import random

#: Names that operators use inside; they must not disturb anything as columns of the input.
CLASHES = ["did", "th", "n", "ph", "key", "fp", "pos", "spans", "count", "word", "_row", "host", "a", "text_key"]


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


def rough_rows():
    """(doc_id, text): nulls, empties, blanks, copies, near copies, ties, repeats, a long text."""
    base, other, passage = words(1, 120), words(2, 90), words(3, 60)
    edited = base.split()
    edited[60] = "changed"
    return [
        (0, base), (1, None), (2, ""), (3, " \t\n "), (4, base), (5, other + ". " + passage), (6, passage + "\n" + other),
        (7, "  " + base.replace(" ", "  ") + "\n"), (8, "one"), (9, "One"), (10, " ".join(edited)), (11, "a" * 700),
        (12, "naïve Ünïcode — 東京 العربية 😀 don't we'll  x y z\x1cw " + passage), (13, words(4, 30000)),
        (14, base), (14, base), (15, other), (15, base), (None, base), (None, None), (16, passage + " " + passage),
        (17, "!!! ### 123 456"), (18, "\n\n  trailing  "), (19, "abc " * 300), (20, words(4, 30000)[5000:9000]),
    ]


def frame(spark, rows, clash=True):
    df = spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, None if i == 5 else f"s{(i or 0) % 4}")
                                for i, t in rows], "doc_id long, text string, lang string, source string")
    if clash:
        from pyspark.sql import functions as F

        for c in CLASHES:
            df = df.withColumn(c, F.lit(None).cast("string") if c in ("n", "a") else F.lit("x"))
    return df.repartition(3)


def key(row):
    return tuple((x is not None, x) for x in row)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
