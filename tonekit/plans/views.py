"""Analog corpora over the driver tables.

The library works on any scored message table with the columns
``msg_id, author, author_name, party, state, ts, year, text`` plus score columns.
The driver data is a TPC-H-like star schema, so three views map it onto that model:

* ``posts``  -- orders as messages, customers as authors, market segment as party,
  nation as state; scores are a fact-to-fact join to per-order line-item statistics
  (the messages-join-scores shape of a real scored corpus).  Optional text: the
  document whose id is the order key modulo the document count.
* ``msgs``   -- events as messages with real clock times; text is composed from
  ids so that retweet, call-out and reply forms occur.
* ``docs``   -- documents, scored by the built-in lexicon scorer where scores are needed.

Every view has a DuckDB twin in :mod:`tonekit.plans.oracle_views` with identical values.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import fixed_broadcast
from ..operators.paging import row_index
from ..session import stored
from ..sources.files import read_table, write_bucketed

SEGMENT_PARTY = {"BUILDING": "Democrat", "FURNITURE": "Democrat",
                 "MACHINERY": "Republican", "HOUSEHOLD": "Republican"}
BIRTH_ORIGIN = "1925-01-01"
BIRTH_SPAN_DAYS = 18262
BIRTH_STEP = 7919
N_HANDLES = 150
ANGER_SCALE = 510000.0


def _party_of_segment(seg) -> F.Column:
    expr = None
    for s, p in SEGMENT_PARTY.items():
        expr = F.when(seg == s, p) if expr is None else expr.when(seg == s, p)
    return expr.otherwise("Independent")


def order_scores(spark: SparkSession, root: str) -> DataFrame:
    """Per-order score table (one row per order that has line items)."""
    li = read_table(spark, root, "lineitem", ["l_orderkey", "l_discount", "l_tax", "l_quantity"])
    return li.groupBy(F.col("l_orderkey").alias("msg_id")).agg(
        (F.avg("l_discount") / 0.11).alias("negative"),
        (F.avg("l_tax") / 0.09).alias("disgust"),
        (F.avg("l_quantity") / 51).alias("joy"),
        (F.max("l_discount") / 0.11).alias("optimism"),
        (F.min("l_quantity") / 51).alias("fear"),
        (F.max("l_tax") / 0.09).alias("sadness"),
    )


_ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"]


def store_posts(spark: SparkSession, root: str, buckets: int | None = None) -> tuple[str, str]:
    """Write messages and scores as catalogue tables of as many buckets each, by the id; returns their
    names, for ``posts(stored=...)``. Written once, they serve every view that joins the two."""
    tag = uuid.uuid4().hex
    names = f"messages_{tag}", f"scores_{tag}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = read_table(spark, root, "orders", _ORDER_COLS)
    # dealt out as the buckets are, so that a task writes one file of its own bucket
    write_bucketed(orders.repartition(buckets, "o_orderkey"), names[0], "o_orderkey", buckets)
    write_bucketed(order_scores(spark, root).repartition(buckets, "msg_id"), names[1], "msg_id", buckets)
    return names


def posts(spark: SparkSession, root: str, with_terms: bool = False, stored: tuple[str, str] | None = None) -> DataFrame:
    """Orders as messages.  Join order for scale: the fact-to-fact join with the
    per-order scores first (both keyed by the order id, the score side already
    partitioned by it), then ONE join with a customer-sized person table that carries
    nation, region and -- with ``with_terms`` -- the folded terms of office.

    ``stored``: the tables of :func:`store_posts`; the first join then reads co-located buckets."""
    if stored:
        o, scores = (spark.table(name) for name in stored)
    else:
        o, scores = read_table(spark, root, "orders", _ORDER_COLS), order_scores(spark, root)
    msg = o.join(scores, o.o_orderkey == F.col("msg_id"))
    c = read_table(spark, root, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    # nation (25 rows) and region (5 rows) have a fixed size by the schema's definition
    n = fixed_broadcast(read_table(spark, root, "nation", ["n_nationkey", "n_name", "n_regionkey"]))
    r = fixed_broadcast(read_table(spark, root, "region", ["r_regionkey", "r_name"]))
    people = (c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
               .select("c_custkey", "c_name", "c_mktsegment", "n_name", "r_name"))
    if with_terms:
        from ..operators.enrich import fold_terms

        people = people.join(fold_terms(author_terms(spark, root), "author")
                             .withColumnRenamed("author", "c_custkey"), "c_custkey", "left")
    base = msg.join(people, msg.o_custkey == people.c_custkey)
    base = base.select(
        F.col("msg_id"),
        F.col("o_custkey").alias("author"),
        F.col("c_name").alias("author_name"),
        _party_of_segment(F.col("c_mktsegment")).alias("party"),
        F.col("n_name").alias("state"),
        F.col("r_name").alias("region"),
        F.col("o_orderdate").alias("ts"),
        F.year("o_orderdate").alias("year"),
        (F.col("o_totalprice") / F.lit(ANGER_SCALE)).alias("anger"),
        F.date_add(F.lit(BIRTH_ORIGIN).cast("date"),
                   ((F.col("o_custkey") * BIRTH_STEP) % BIRTH_SPAN_DAYS).cast("int")).alias("birthday"),
        "negative", "disgust", "joy", "optimism", "fear", "sadness",
        *(["_terms"] if with_terms else []),
    )
    return base


def numbered_documents(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """(doc_id, text, _doc) of every document, ``_doc`` its number from 0 in the order of the ids, and
    how many there are. Ids that are 0 to n - 1 already are their own numbers; others are numbered
    by a row index over the ids."""
    docs = read_table(spark, root, "documents", ["doc_id", "text"]).filter(F.col("doc_id").isNotNull())
    n, low, high, ids, total = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id"), F.count_distinct("doc_id"),
                                        F.sum(F.col("doc_id").cast("decimal(38,0)"))).first()
    if n == ids and (not n or (low, high, int(total)) == (0, n - 1, n * (n - 1) // 2)):
        return docs.withColumn("_doc", F.col("doc_id")), n
    numbers = row_index(docs.select("doc_id").distinct(), ["doc_id"])
    return docs.join(numbers.rows("_doc"), "doc_id"), numbers.size


def attach_document_text(spark: SparkSession, root: str, df: DataFrame, key: str = "msg_id",
                         scored: bool = False, tokens: bool = False, flags: dict | None = None,
                         also: dict | None = None, keep_text: bool = True) -> DataFrame:
    """Give each message the whole text of document ``key mod #documents``.

    Text features are computed once per document, before the join, rather than once
    per message that reuses the text: ``scored`` adds the lexicon scores, ``tokens``
    the distinct-token array, ``flags`` one boolean per named pattern, ``also`` further
    named expressions over ``text``.  Without ``keep_text`` only the features travel."""
    docs, n_docs = numbered_documents(spark, root)
    if scored:
        from ..operators.scoring import lexicon_scores

        docs = lexicon_scores(docs)
    if tokens:
        from ..functions.text import tokens as tok

        docs = docs.withColumn("tokens", tok("text"))
    if flags:
        from ..operators.registers import text_flags

        docs = text_flags(docs, flags)
    for name, c in (also or {}).items():
        docs = docs.withColumn(name, c)
    if not keep_text:
        docs = docs.drop("text")
    return df.withColumn("_doc", F.pmod(F.col(key), F.lit(n_docs))).join(docs.drop("doc_id"), "_doc").drop("_doc")


#: Rows that :func:`winners_with_text` sends to every task at most; more are joined by shuffles.
FEW = 100_000


def winners_with_text(spark: SparkSession, root: str, winners: DataFrame, id_col: str) -> DataFrame:
    """``winners`` (k peaks, or two rows a month) with ``author_name`` and ``text`` of the message named
    in ``id_col``.  They are written and counted first: if they are FEW, they are broadcast to the
    message and document tables and neither is shuffled."""
    won = stored(winners, "winners")
    small = F.broadcast if won.count() <= FEW else (lambda df: df)
    o = read_table(spark, root, "orders", ["o_orderkey", "o_custkey"])
    c = read_table(spark, root, "customer", ["c_custkey", "c_name"])
    w = small(won.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("o_orderkey")).distinct())
    who = small(o.join(w, "o_orderkey")).join(c, F.col("o_custkey") == c.c_custkey)
    who = who.select(F.col("o_orderkey").alias(id_col), F.col("c_name").alias("author_name"))
    docs, n_docs = numbered_documents(spark, root)
    named = small(who.withColumn("_doc", F.pmod(F.col(id_col), F.lit(n_docs))))
    text = docs.join(named, "_doc").select(id_col, "author_name", "text")
    return won.join(text, id_col, "left")


def author_terms(spark: SparkSession, root: str) -> DataFrame:
    """Two terms of office per customer, with a gap between them (for D4)."""
    c = read_table(spark, root, "customer", ["c_custkey"])
    s1 = F.date_add(F.lit("1994-07-01").cast("date"), ((F.col("c_custkey") * 37) % 730).cast("int"))
    t1 = c.select(F.col("c_custkey").alias("author"), s1.alias("term_start"),
                  F.date_add(s1, 1460).alias("term_end"))
    t2 = t1.select("author", F.date_add("term_end", 400).alias("term_start"),
                   F.date_add("term_end", 400 + 1460).alias("term_end"))
    return t1.unionByName(t2)


def _handle(x) -> F.Column:
    return F.concat(F.lit("U"), x.cast("string"))


def msgs(spark: SparkSession, root: str) -> DataFrame:
    return msgs_from_events(read_table(spark, root, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"]))


def msgs_from_events(e: DataFrame) -> DataFrame:
    """The ``msgs`` projection of an events frame (batch or streaming)."""
    u, i = F.col("user_id"), F.col("event_id")
    block = u - u % N_HANDLES  # mentions stay within the author's block of N_HANDLES users
    tgt = _handle(block + (u * 7 + i % 3) % N_HANDLES)
    tgt2 = _handle(block + (u + (i % 2) * 5) % N_HANDLES)
    et = F.col("event_type")
    kind = i % 5
    text = (F.when(kind == 0, F.concat(F.lit("RT @"), tgt, F.lit(": "), et, F.lit(" news")))
             .when(kind == 1, F.concat(F.lit("Hey .@"), tgt, F.lit(" and .@"), tgt2, F.lit(" stop the "), et))
             .when(kind == 2, F.concat(F.lit("@"), tgt, F.lit(" thanks for the "), et))
             .when(kind == 3, F.concat(F.lit(".@"), tgt, F.lit(" we must work together on "), et))
             .otherwise(F.concat(F.lit("Proud to "), et, F.lit(" today https://t.co/"), i.cast("string"))))
    party = (F.when(u % 4 == 0, "Democrat").when(u % 4 == 1, "Republican")
              .when(u % 4 == 2, "Independent").otherwise(F.lit(None).cast("string")))
    states = ["NY", "CA", "TX", "AZ", "HI", "GUAM", "MARIANA", "ZZ"]
    state = None
    for k, s in enumerate(states):
        state = F.when(u % 9 == k, s) if state is None else state.when(u % 9 == k, s)
    state = state.otherwise(F.lit(None).cast("string"))
    chambers = ["Senate", "senator", "House", "representative"]
    chamber = None
    for k, s in enumerate(chambers):
        chamber = F.when(u % 5 == k, s) if chamber is None else chamber.when(u % 5 == k, s)
    chamber = chamber.otherwise("other")
    k_val = F.get_json_object("props", "$.k").cast("double") / 99
    return e.select(
        i.alias("msg_id"), u.alias("author"), F.concat(F.lit("User "), u.cast("string")).alias("author_name"),
        _handle(u).alias("handle"), party.alias("party"), state.alias("state"), chamber.alias("chamber"),
        F.col("ts"), F.year("ts").alias("year"), et.alias("topic"), text.alias("text"),
        (F.col("value") / (F.col("value") + 50)).alias("anger"),
        k_val.alias("disgust"),
        ((F.col("value") / (F.col("value") + 50) + k_val) / 2).alias("negative"),
        (F.lit(1.0) - F.col("value") / (F.col("value") + 50)).alias("joy"),
    )


def analysis_posts(spark: SparkSession, root: str, tokens: bool = False) -> DataFrame:
    """The analysis view ``d``: scored posts with calendar, election-cycle, age and
    tenure features, restricted to messages written in office; with ``tokens`` the distinct
    tokens of each message's text."""
    from ..operators.enrich import add_age, add_calendar, in_office_flag, scored_view

    p = posts(spark, root, with_terms=True)
    p = add_calendar(p)
    p = add_age(p)
    p = p.withColumn("in_office", in_office_flag("_terms")).drop("_terms")
    p = scored_view(p)  # scores are already joined in ``posts``; the test years need no range
    return attach_document_text(spark, root, p, tokens=True, keep_text=False) if tokens else p


def local_msgs(spark: SparkSession, root: str) -> DataFrame:
    """``msgs`` with territory spellings fixed and the home-zone hour added."""
    from ..operators.enrich import add_zone_hour, normalise_state, zone_table

    m = msgs(spark, root).withColumn("state", normalise_state("state"))
    return add_zone_hour(m, zone_table(spark))
