"""Sources and sinks over the given tables: written to the shared folder, read back
(A3-A9, A12, A15, L4-L6)."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import link as L
from ..operators.export import write_json_arrays, write_json_lines
from ..operators.paging import row_index
from ..session import checkpoint_dir
from ..sources import files as S
from . import oracle_views as O
from .link_queries import _FIRST, _LAST, _names
from .registry import register
from .views import author_terms, posts, store_posts


def _new(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


@register("csv_roundtrip", "SELECT s_suppkey, s_name, s_nationkey, ROUND(s_acctbal, 6) AS s_acctbal FROM supplier")
def csv_roundtrip(spark, root):
    """The suppliers through a CSV with header."""
    path = _new(spark, "csv")
    d = S.read_table(spark, root, "supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])
    S.write_csv(d, path)
    return S.read_csv(spark, path, d.schema)


@register("parquet_glob", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, ROUND(sum(o_totalprice), 2) AS total "
                          "FROM orders GROUP BY 1")
def parquet_glob(spark, root):
    """The orders as ZSTD Parquet by year, written once, read by a glob of the first
    path that exists."""
    path = _new(spark, "orders")
    d = S.read_table(spark, root, "orders", ["o_orderkey", "o_orderdate", "o_totalprice"]).withColumn("year", F.year("o_orderdate"))
    S.write_if_absent(d, path, partition_by=["year"])
    S.write_if_absent(d.limit(1), path, partition_by=["year"])  # exists already: left as it is
    found = S.first_existing(spark, [f"{path}/none=*", f"{path}/year=*"])
    back = S.read_glob(spark, found)
    return back.groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("text_lines", """SELECT doc_id, count(*) AS lines, CAST(sum(length(l)) AS BIGINT) AS chars
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) x WHERE trim(l, ' ') <> '' GROUP BY doc_id""")
def text_lines(spark, root):
    """The documents as text files, one line a row (with its document's number in front),
    blank lines dropped."""
    path = _new(spark, "lines")
    d = S.read_table(spark, root, "documents", ["doc_id", "text"])
    rows = d.select("doc_id", F.explode(F.split("text", "\n")).alias("l")).filter(F.trim("l") != "")
    rows.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.regexp_replace("l", "\r", "\u2424")).alias("value")
                ).write.text(path)
    back = S.read_lines(spark, path).select(
        F.substring_index("text", "\t", 1).cast("long").alias("doc_id"), F.expr("substring(text, instr(text, '\t') + 1)").alias("l"))
    return back.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("l")).alias("chars"))


def _records(spark, root):
    """The customers as nested records with their terms."""
    c = S.read_table(spark, root, "customer", ["c_custkey", "c_nationkey"])
    k = F.col("c_custkey")
    first, last = _names(k)
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    terms = author_terms(spark, root).groupBy(F.col("author").alias("c_custkey")).agg(F.sort_array(F.collect_list(F.struct(
        day("term_start").alias("start"), day("term_end").alias("end")))).alias("t"))
    return c.join(terms, "c_custkey").select(
        F.struct(F.concat(F.lit("P"), k.cast("string")).alias("bioguide")).alias("id"),
        F.struct(F.lit("1950-02-01").alias("birthday"), F.when(k % 2 == 0, "F").alias("gender")).alias("bio"),
        F.struct(first.alias("first"), last.alias("last")).alias("name"),
        F.transform("t", lambda t: F.struct(F.lit("rep").alias("type"), t["start"].alias("start"), t["end"].alias("end"),
                                            F.col("c_nationkey").cast("string").alias("state"))).alias("terms"))


@register("record_terms", O.with_views("""SELECT 'P' || CAST(author AS VARCHAR) AS bioguide, 'rep' AS term_type, term_start, term_end,
       CAST(c_nationkey AS VARCHAR) AS term_state, CAST(NULL AS VARCHAR) AS term_party
FROM t JOIN customer ON c_custkey = author""", t=O.TERMS))
def record_terms(spark, root):
    """Nested records written and read as JSON lines, one row per term."""
    path = _new(spark, "records")
    write_json_lines(_records(spark, root), path)
    return L.explode_terms(spark.read.schema(L.LEGISLATOR_SCHEMA).json(path))


@register("record_people", O.with_views(f"""SELECT 'P' || CAST(k AS VARCHAR) AS bioguide, {_FIRST} AS first, {_LAST} AS last,
       CAST(NULL AS VARCHAR) AS nickname, CAST(NULL AS VARCHAR) AS official_full, [CAST(c_nationkey AS VARCHAR)] AS states,
       CAST(e AS VARCHAR) AS last_term_end, DATE '1950-02-01' AS birthday, CASE WHEN k % 2 = 0 THEN 'F' END AS gender
FROM (SELECT author AS k, max(term_end) AS e FROM t GROUP BY author) x JOIN customer ON c_custkey = k""", t=O.TERMS))
def record_people(spark, root):
    """The flat person table of nested records that lie in two sets of files, each file one
    JSON array: people of even states' numbers (the current ones) and the others."""
    rec, paths = _records(spark, root), [_new(spark, "current"), _new(spark, "historical")]
    even = F.col("terms")[0]["state"].cast("int") % 2 == 0
    write_json_arrays(rec.filter(even), paths[0], per_file=500)
    write_json_arrays(rec.filter(~even), paths[1], per_file=500)
    return L.people_from_records(S.read_json_records(spark, paths, L.LEGISLATOR_SCHEMA))


#: Records of a YAML file: a file is parsed by one task.
YAML_FILE = 2000
SNAPSHOTS = ["social-2015", "social-2017", "social-2019", "social-now"]  # in the order of time, not of names


@register("handle_history", """WITH s AS (SELECT unnest(range(4)) AS i),
h AS (SELECT i, c_custkey AS k, lower(CASE WHEN c_custkey % 5 = i THEN 'Alt' ELSE 'Rep' END || CAST(c_custkey AS VARCHAR)) AS handle
      FROM customer, s WHERE (c_custkey + i) % 4 > 0),
r AS (SELECT *, i - row_number() OVER (PARTITION BY k, handle ORDER BY i) AS run FROM h)
SELECT handle, 'P' || CAST(k AS VARCHAR) AS bioguide, CAST(min(i) AS INTEGER) AS "from",
       CAST(CASE WHEN max(i) < 3 THEN max(i) + 1 END AS INTEGER) AS "to" FROM r GROUP BY k, handle, run""")
def handle_history(spark, root):
    """A5: four snapshots of the customers' handles, written as YAML lists, the newest as JSON arrays, and
    read at once; per handle the snapshots during which a person had it. A quarter of the people is
    missing from each snapshot, a fifth has another handle in it."""
    base = _new(spark, "snapshots")
    k = F.col("c_custkey")
    person, people = F.concat(F.lit("P"), k.cast("string")), S.read_table(spark, root, "customer", ["c_custkey"])
    paths = []
    for at, name in enumerate(SNAPSHOTS):
        handle = F.concat(F.when(k % 5 == at, "Alt").otherwise("Rep"), k.cast("string"))
        there = (k + at) % 4 > 0
        paths.append(f"{base}/{name}")
        if name == "social-now":
            write_json_arrays(people.filter(there).select(F.struct(person.alias("bioguide")).alias("id"),
                                                          F.struct(handle.alias("twitter")).alias("social")), paths[-1], per_file=400)
        else:
            people.select(F.concat(F.lit("- id: {bioguide: "), person, F.lit("}\n  social: {twitter: "),
                                   F.when(there, handle).otherwise(""), F.lit("}")).alias("value")
                          ).write.option("maxRecordsPerFile", YAML_FILE).text(paths[-1])
    found = L.snapshot_handles(spark, paths)
    return L.handle_intervals(found)


@register("pages_of_orders", """WITH o AS (SELECT o_orderkey, o_orderdate FROM orders)
SELECT *, row_number() OVER (ORDER BY page, o_orderdate DESC, o_orderkey) - 1 AS pos FROM (
  SELECT * FROM (SELECT o_orderkey, 0 AS page, o_orderdate FROM o ORDER BY o_orderdate DESC, o_orderkey LIMIT 700 OFFSET 0) a
  UNION ALL SELECT * FROM (SELECT o_orderkey, 1, o_orderdate FROM o ORDER BY o_orderdate DESC, o_orderkey LIMIT 700 OFFSET 700) b
  UNION ALL SELECT * FROM (SELECT o_orderkey, 2, o_orderdate FROM o ORDER BY o_orderdate DESC, o_orderkey LIMIT 700 OFFSET 1400) c) x""")
def pages_of_orders(spark, root):
    """the first three pages of 700 orders, newest first, and where in the order each row stands."""
    o = S.read_table(spark, root, "orders", ["o_orderkey", "o_orderdate"])
    index = row_index(o, [F.col("o_orderdate").desc_nulls_last(), "o_orderkey"])
    pages = [index.page(i, 700, "pos").withColumn("page", F.lit(i)) for i in range(3)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@register("row_numbers", """SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS pos
FROM lineitem""")
def row_numbers(spark, root):
    """every line item's place in the order of shipping."""
    li = S.read_table(spark, root, "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate"])
    return row_index(li, ["l_shipdate", "l_orderkey", "l_linenumber"]).rows("pos").drop("l_shipdate")


@register("colocated_posts", O.with_views("""SELECT year, party, count(*) AS n, ROUND(avg(anger), 6) AS anger, ROUND(avg(negative), 6) AS negative,
       ROUND(avg(joy), 6) AS joy FROM p GROUP BY ALL""", p=O.POSTS))
def colocated_posts(spark, root):
    """The posts view over messages and scores that are stored bucketed by the id, so that the join of
    the two fact tables moves no row of either."""
    return posts(spark, root, stored=store_posts(spark, root)).groupBy("year", "party").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("anger", "negative", "joy")])

