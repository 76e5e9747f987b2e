"""Entity linkage: message authors -> people.

Matching is a cascade of three stages:

1. handle      -- lower-cased handle against the social-handle table (earliest
                  snapshot first);
2. name        -- (first, last) keys of the author's name, last-name candidates
                  longest first, against every (first | nickname | first word of the
                  official name, last) key of each person; in the author's state when
                  known; several -> the most recent last term;
3. last+state  -- last-name candidate + state, people whose last term ends in or after
                  a cut year, only when exactly one person qualifies.

The people are reduced to one answer per key before authors meet them, so no join
pairs namesakes.  All tables involved are people- or author-sized; the message table
is read once for the author summary.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import text as TX
from ..session import stored


def author_summary(msgs: DataFrame, handle: str = "author_handle", name: str = "author_name",
                   state: str = "state", chamber: str = "chamber",
                   congress=K.CONGRESS_CHAMBERS) -> DataFrame:
    """Per handle, the most common name and state (NULLs ignored, ties ->
    smallest, all NULL -> NULL), whether most messages carry a congressional chamber
    (NULL counts as no) and the message count.

    The messages are counted once per (handle, name, state, in chamber), those counts once per
    (handle, which attribute, value), and the few values of a handle decide; there is no join."""
    in_set = F.coalesce(F.col(chamber).isin(*congress), F.lit(False))
    cells = msgs.groupBy(handle, name, state, in_set.alias("_in")).agg(F.count(F.lit(1)).alias("_n"))
    both = F.array(*[F.struct(F.lit(i).alias("_k"), F.col(c).cast("string").alias("_v")) for i, c in enumerate((name, state))])
    counts = cells.select(handle, "_n", F.when(F.col("_in"), F.col("_n")).otherwise(0).alias("_c"), F.inline(both)).groupBy(
        handle, "_k", "_v").agg(F.sum("_n").alias("_n"), F.sum("_c").alias("_c"))

    def mode(k: int, out: str):
        known = (F.col("_k") == k) & F.col("_v").isNotNull()
        return F.min(F.when(known, F.struct(-F.col("_n"), F.col("_v"))))["_v"].alias(out)

    first = F.col("_k") == 0  # every message counts once under each attribute
    return counts.groupBy(handle).agg(
        mode(0, name), mode(1, state),
        (F.sum(F.when(first, F.col("_c"))) / F.sum(F.when(first, F.col("_n"))) > 0.5).alias("is_congress"),
        F.sum(F.when(first, F.col("_n"))).alias("n_tweets"))


def name_candidates(authors: DataFrame, handle: str = "author_handle", name: str = "author_name",
                    keep: Sequence[str] = ()) -> DataFrame:
    """(handle, first, last candidate, rank, columns to keep) -- rank 0 is the longest candidate.

    ``Last, First`` and ``First Middle Last`` forms; a trailing party-state tag and a
    generational suffix are removed first; one-word names give no candidates."""
    n = F.trim(TX.clean_display_name(F.col(name)))
    n = F.trim(TX.rx_replace(n, "(?i)" + K.NAME_SUFFIX, ""))
    d = authors.select(handle, *keep, n.alias("_n"))
    comma = F.instr(F.col("_n"), ",") > 0
    last_part = F.trim(F.substring_index(F.col("_n"), ",", 1))
    first_part = F.trim(F.expr("substring(_n, instr(_n, ',') + 1)"))
    words = F.split(F.col("_n"), r"\s+")
    d = d.select(handle, *keep, "_n",
                 F.when(comma, first_part).otherwise(F.element_at(words, 1)).alias("_first_raw"),
                 F.when(comma, F.split(last_part, r"\s+")).otherwise(
                     F.when(F.size(words) >= 2, F.slice(words, 2, F.size(words) - 1))).alias("_lp"),
                 (comma | (F.size(words) >= 2)).alias("_ok"))
    d = d.filter("_ok")
    d = d.select(handle, *keep, "_first_raw", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size("_lp")), lambda i: F.array_join(F.slice("_lp", i, F.size("_lp") - i + 1), " ")
    )).alias("rank", "_last_raw"))
    d = d.withColumn("first", F.element_at(F.split(TX.fold_ascii(F.col("_first_raw")), " "), 1))
    d = d.withColumn("first", F.when(F.col("first") == "", None).otherwise(F.col("first")))
    d = d.withColumn("last", TX.fold_ascii(F.col("_last_raw")))
    return d.filter(F.col("last") != "").select(handle, "first", "last", "rank", *keep)


def person_keys(people: DataFrame) -> DataFrame:
    """C20: every (first, last) key of a person: first name, nickname and the first word
    of the official name, each folded and cut to its first word."""
    firsts = F.array_distinct(F.filter(F.array(
        F.col("first"), F.col("nickname"),
        F.when(F.coalesce(F.col("official_full"), F.lit("")) != "", F.element_at(F.split("official_full", " "), 1))),
        lambda x: x.isNotNull() & (x != "")))
    p = people.select("bioguide", "states", "last_term_end", F.explode(firsts).alias("_f"),
                      TX.fold_ascii(F.col("last")).alias("last"))
    return p.select("bioguide", "states", "last_term_end", "last",
                    F.element_at(F.split(TX.fold_ascii(F.col("_f")), " "), 1).alias("first")).distinct()


def link_authors(authors: DataFrame, people: DataFrame, handles: DataFrame,
                 handle: str = "author_handle", state: str = "state", cut_year: str = "2005") -> DataFrame:
    """The cascading match; returns authors with ``bioguide`` and ``match_method``.

    ``people``: bioguide, first, last, nickname, official_full, states (array),
    last_term_end (ISO date string).  ``handles``: handle, bioguide, snapshot (the
    earliest snapshot wins for a handle).  An empty or NULL state is unknown.

    The people are first reduced to the one answer of each key -- best person per (first,
    last, state) and per (first, last), the only person per (last, state) -- in one table, and
    every candidate meets it once, by the keys it asks for; its rows grow with the candidates,
    whatever namesakes there are. The authors, which two branches read, are written once."""
    a = stored(authors, "authors").select("*", F.lower(handle).alias("_h"), F.nullif(F.col(state), F.lit("")).alias("_s"))
    seen = (handles.filter(F.col("handle").isNotNull()).groupBy(F.lower("handle").alias("_h"))
            .agg(F.min(F.struct("snapshot", "bioguide")).alias("_m")).select("_h", F.col("_m.bioguide").alias("_b1")))
    a = a.join(seen, "_h", "left")
    cands = name_candidates(a.filter(F.col("_b1").isNull()), handle, keep=["_s"])
    # a candidate asks by full name, in its state if that is known, and by last name and state
    asked = cands.select(handle, "rank", F.explode(F.array(
        F.when(F.col("_s").isNull(), _key(ANYWHERE, "first", "last")).otherwise(_key(IN_STATE, "first", "last", "_s")),
        F.when(F.col("_s").isNotNull(), _key(LAST_NAME, "last", "_s")))).alias("key")).filter(F.col("key").isNotNull())
    hits = asked.join(person_answers(people, cut_year), "key")

    def first(by_last: bool):
        """The match of the longest candidate that has one."""
        of = F.col("key").startswith(LAST_NAME) if by_last else ~F.col("key").startswith(LAST_NAME)
        return F.min(F.when(of, F.struct("rank", "b")))["b"]

    found = hits.groupBy(handle).agg(first(False).alias("_b2"), first(True).alias("_b3"))
    out = a.join(found, handle, "left")
    method = (F.when(F.col("_b1").isNotNull(), "handle").when(F.col("_b2").isNotNull(), "name")
              .when(F.col("_b3").isNotNull(), "lastname+state"))
    out = out.select(*authors.columns, F.coalesce("_b1", "_b2", "_b3").alias("bioguide"), method.alias("match_method"))
    extra = [x for x in ("birthday", "gender") if x in people.columns]
    if extra:  # person attributes of the match (people-sized join)
        out = out.join(people.select("bioguide", *extra), "bioguide", "left")
    return out


#: Kinds of keys: full name and state, full name, last name and state.
IN_STATE, ANYWHERE, LAST_NAME = "s", "a", "l"


def _key(kind: str, *parts: str):
    """One string; NULL if a part is. The parts are folded names and state names, without control characters."""
    out = F.lit(kind)
    for p in parts:
        out = F.concat(out, F.lit("\x1f"), F.col(p))
    return out


def person_answers(people: DataFrame, cut_year: str) -> DataFrame:
    """(key, b): the person that each key stands for. Of several under a full name the one with the latest
    last term (a missing one counts as earliest), ties to the smallest id; a last name and state stand for
    a person only if no other with a term from ``cut_year`` on has them."""
    full = person_keys(people).select("bioguide", "last_term_end", F.explode(F.concat(
        F.array(_key(ANYWHERE, "first", "last")),
        F.transform(F.array_distinct("states"), lambda s: F.concat(_key(IN_STATE, "first", "last"), F.lit("\x1f"), s)))).alias("key"))
    last = people.filter(F.col("last_term_end") >= cut_year).select(
        "bioguide", "last_term_end", TX.fold_ascii(F.col("last")).alias("last"), F.explode(F.array_distinct("states")).alias("_s"))
    rows = full.unionByName(last.select("bioguide", "last_term_end", _key(LAST_NAME, "last", "_s").alias("key")))
    # people of one key and last term first, so that a key many share is a row a term
    terms = rows.filter(F.col("key").isNotNull()).groupBy("key", "last_term_end").agg(
        F.min("bioguide").alias("b"), F.count(F.lit(1)).alias("_n"))
    best = terms.groupBy("key").agg(F.max(F.struct("last_term_end", "b"))["b"].alias("b"), F.sum("_n").alias("_n"))
    return best.filter((F.col("_n") == 1) | ~F.col("key").startswith(LAST_NAME)).select("key", "b")


def match_report(linked: DataFrame, top: int = 30, handle: str = "author_handle") -> tuple[DataFrame, DataFrame]:
    """Counts by method among congressional authors with the message-weighted
    coverage, and the top unmatched authors by message count."""
    c = linked.filter("is_congress")
    counts = c.groupBy("match_method").agg(F.count(F.lit(1)).alias("authors"), F.sum("n_tweets").alias("messages"))
    unmatched = (c.filter(F.col("bioguide").isNull()).select(handle, "author_name", "state", "n_tweets")
                  .orderBy(F.desc("n_tweets"), handle).limit(top))
    return counts, unmatched


# A4: explicit schema of a legislator record (no inference pass over many files; missing
# nested fields read as NULL instead of disappearing from the inferred type).
LEGISLATOR_SCHEMA = T.StructType([
    T.StructField("id", T.StructType([T.StructField("bioguide", T.StringType())])),
    T.StructField("bio", T.StructType([T.StructField("birthday", T.StringType()),
                                       T.StructField("gender", T.StringType())])),
    T.StructField("name", T.StructType([T.StructField(f, T.StringType())
                                        for f in ("first", "last", "nickname", "official_full")])),
    T.StructField("terms", T.ArrayType(T.StructType([T.StructField(f, T.StringType())
                                                     for f in ("type", "start", "end", "state", "party")]))),
])


def explode_terms(people_json: DataFrame) -> DataFrame:
    """One row per (person, term) from nested legislator records."""
    t = people_json.select(F.col("id.bioguide").alias("bioguide"), F.explode("terms").alias("t"))
    return t.select("bioguide", F.col("t.type").alias("term_type"), F.to_date("t.start").alias("term_start"),
                    F.to_date("t.end").alias("term_end"), F.col("t.state").alias("term_state"),
                    F.col("t.party").alias("term_party"))


def people_from_records(people_json: DataFrame) -> DataFrame:
    """Flat person table from nested records: names, distinct term states,
    the end of the last term, birthday and gender."""
    return people_json.select(
        F.col("id.bioguide").alias("bioguide"), F.col("name.first").alias("first"), F.col("name.last").alias("last"),
        F.col("name.nickname").alias("nickname"), F.col("name.official_full").alias("official_full"),
        F.array_distinct(F.transform("terms", lambda t: t["state"])).alias("states"),
        F.element_at("terms", -1)["end"].alias("last_term_end"),
        F.to_date("bio.birthday").alias("birthday"), F.col("bio.gender").alias("gender"))


#: Records of a YAML list that are loaded at once.
YAML_CHUNK = 500


def yaml_records(text: str, chunk: int = YAML_CHUNK) -> list:
    """The records of a YAML list, as ``yaml.safe_load`` gives them, by libyaml where it is installed.

    A list that starts in its first column is cut before every ``chunk``-th line that starts a record
    there, so the nodes of one piece are held at a time. A piece that is no list of its own (an alias
    of an earlier one, a quoted text with such a line) has the whole text loaded at once."""
    import re

    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    starts = [m.start() for m in re.finditer(r"^- ", text, re.M)]
    if len(starts) > chunk and starts[0] == 0:
        cuts, out = [*starts[::chunk], len(text)], []
        try:
            for lo, hi in zip(cuts, cuts[1:]):
                out += yaml.load(text[lo:hi], loader)
            return out
        except (yaml.YAMLError, TypeError):
            pass
    return yaml.load(text, loader) or []


def snapshot_handles(spark, paths: Sequence[str]) -> DataFrame:
    """A5: social-handle snapshots (YAML or JSON lists of records) as
    (handle, bioguide, snapshot, at) rows, earliest first.

    The order is that of ``paths``: ``at`` is the position of the path (a folder or glob counts
    once, and may hold any number of files), ``snapshot`` starts with it and ends with the file
    name.  All paths are one ``binaryFile`` read; a table of the paths' places, joined to the
    files by their folders, gives the order.  The files are parsed in Python workers where they are
    read: only their names are joined, and go to every task.  A file is one task's work, so a large
    snapshot should be many files."""
    import json as _json

    import pandas as pd

    schema = "handle string, bioguide string, snapshot string, at int"

    def parse(batches):
        for pdf in batches:
            rows = []
            for at, path, content in zip(pdf["at"], pdf["path"], pdf["content"]):
                text = bytes(content).decode("utf8")
                data = _json.loads(text) if path.endswith(".json") or text.lstrip().startswith("[{") else yaml_records(text)
                for e in data or []:
                    tw = (e.get("social") or {}).get("twitter")
                    if tw:
                        rows.append((str(tw), e["id"]["bioguide"], f"{at:06d}/{path.rsplit('/', 1)[-1]}", at))
            yield pd.DataFrame(rows, columns=["handle", "bioguide", "snapshot", "at"])

    places = spark.createDataFrame(_places(spark, paths), "root string, at int")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "content")
    # a file belongs to the first of the paths that is the file itself or a folder above it
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.call_function("substring_index", F.col("path"), F.lit("/"), n))
    owner = files.select("path", F.explode(above).alias("root")).join(places, "root").groupBy("path").agg(F.min("at").alias("at"))
    return files.join(F.broadcast(owner), "path").mapInPandas(parse, schema)


def _places(spark, paths: Sequence[str]) -> list[tuple[str, int]]:
    """(qualified file or folder, position) of what each path or glob names; names only."""
    out = []
    for at, path in enumerate(paths):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        out += [(s.getPath().toString(), at) for s in fs.globStatus(p) or []]
    return out


def handle_intervals(handles: DataFrame, handle: str = "handle", person: str = "bioguide", at: str = "at") -> DataFrame:
    """A5: (handle, person, from, to): the runs of consecutive snapshots that name a person's handle,
    by snapshot number; ``to`` is the first snapshot without it, NULL if the last one still has it.
    Handles differ by more than case.

    Snapshots are few; a handle and person have one row a snapshot, so no window holds more. The rows are
    written once: the files behind them are parsed once."""
    seen = stored(handles.select(F.lower(F.col(handle)).alias(handle), person, at).distinct(), "handles")
    snaps = seen.select(at).distinct().withColumn("_k", F.row_number().over(Window.orderBy(at)))
    runs = seen.join(F.broadcast(snaps), at).withColumn(
        "_run", F.col("_k") - F.row_number().over(Window.partitionBy(handle, person).orderBy("_k")))
    spans = runs.groupBy(handle, person, "_run").agg(F.min(at).alias("from"), (F.max("_k") + 1).alias("_k"))
    after = snaps.select("_k", F.col(at).alias("to"))
    return spans.join(F.broadcast(after), "_k", "left").select(handle, person, "from", "to")
