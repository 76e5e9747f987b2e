"""Shaping results for export.

Exports work on aggregated result tables (cells, curves, top lists).  Nested
collections are per-key and bounded by the key's domain (24 hours, 12 months,
one row per year), and a JSON document is one ``to_json`` over such a table.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(c: Column) -> Column:
    """NaN is written as null."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def rounded_for_export(df: DataFrame, digits: int = 4) -> DataFrame:
    """Floats rounded, NaN -> null."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(nan_to_null(F.col(f.name)), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def spine_align(cells: DataFrame, spine: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key of the spine, with NULL where the cell table has no row."""
    return spine.join(cells, list(keys), "left")


def pivot_wide(df: DataFrame, row: str | Sequence[str], col: str, value: str,
               values: Sequence | None = None) -> DataFrame:
    """Long -> wide; passing ``values`` saves the distinct pass over ``col``."""
    rows = [row] if isinstance(row, str) else list(row)
    return df.groupBy(*rows).pivot(col, list(values) if values is not None else None).agg(F.first(value))


def parallel_arrays(df: DataFrame, order: Sequence[str], cols: Sequence[str],
                    group: Sequence[str] = ()) -> DataFrame:
    """One row (per group) holding each column as an array, all in ``order``."""
    rec = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order],
                                               *[F.col(c).alias(f"_v_{c}") for c in cols])))
    out = df.groupBy(*group).agg(rec.alias("_r"))
    def field(name):
        return lambda s: s[f"_v_{name}"]

    return out.select(*group, *[F.transform("_r", field(c)).alias(c) for c in cols])


def json_document(df: DataFrame, out: str = "json") -> DataFrame:
    """A one-row table holding the whole (small) result as compact JSON arrays."""
    arr = parallel_arrays(df, df.columns[:1], df.columns)
    return arr.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias(out))


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A9 (row form): one compact JSON object per line, written by every task."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_json_arrays(df: DataFrame, path: str, per_file: int = 10_000, mode: str = "overwrite") -> None:
    """A4/A9 (array form): files that hold one JSON array of records each, about ``per_file`` of them."""
    files = max(1, -(-df.count() // per_file))
    rec = F.struct(*[F.col(c) for c in df.columns])
    rows = df.select(rec.alias("_r")).withColumn("file", F.pmod(F.xxhash64(F.to_json("_r")), F.lit(files)))
    arrays = rows.groupBy("file").agg(F.to_json(F.collect_list("_r"), {"ignoreNullFields": "false"}).alias("value"))
    arrays.write.mode(mode).partitionBy("file").text(path)


def json_dictionary(df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str], out: str = "json") -> DataFrame:
    """A one-row table holding one compact JSON document ``{key: {column: [values, ...]}}``, the values
    of each key in ``order``; for small results, whose keys and rows a page shows at once."""
    per = parallel_arrays(df, order, cols, group=[key])
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("key"),
                                                   F.struct(*[F.col(c) for c in cols]).alias("value"))))
    return per.agg(F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"}).alias(out))


def hour_profiles(df: DataFrame, who: str, hour: str, flag: str, slots: int = 24) -> DataFrame:
    """Per author, share of flagged messages and message count in each of
    ``slots`` hours as fixed-length arrays (0 / NULL for empty hours), plus the total."""
    cells = df.groupBy(who, hour).agg(F.count(F.lit(1)).alias("_n"), F.avg(flag).alias("_s"))
    per = cells.groupBy(who).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(hour), F.struct("_n", "_s")))).alias("_m"),
        F.sum("_n").alias("total"))
    idx = F.sequence(F.lit(0), F.lit(slots - 1))
    return per.select(who, F.transform(idx, lambda h: F.element_at("_m", h)["_s"]).alias("share"),
                      F.transform(idx, lambda h: F.coalesce(F.element_at("_m", h)["_n"], F.lit(0))).alias("n"),
                      "total")


def circular_lerp(series: DataFrame, targets: DataFrame, x: str = "h", y: str = "v", t: str = "t",
                  bins: int = 24) -> DataFrame:
    """Value of a circular binned series at decimal positions; bins are centred on
    ``h + 0.5`` and neighbours wrap around (bin ``bins-1`` -> 0).  Two equi-joins
    against the (bins-row) series."""
    pos = F.pmod(F.col(t) - F.lit(0.5), F.lit(float(bins)))
    tg = targets.select(t, F.floor(pos).cast("int").alias("_i"), (pos - F.floor(pos)).alias("_f"))
    tg = tg.withColumn("_j", (F.col("_i") + 1) % bins)
    s0 = series.select(F.col(x).cast("int").alias("_i"), F.col(y).alias("_v0"))
    s1 = series.select(F.col(x).cast("int").alias("_j"), F.col(y).alias("_v1"))
    out = tg.join(s0, "_i").join(s1, "_j")
    return out.select(t, (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.col("_f")).alias(y))
