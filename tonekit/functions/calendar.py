"""Calendar and bucketing column functions.

All return ``Column`` expressions built from built-in functions, so they stay
inside whole-stage codegen and are pushed around freely by Catalyst.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def in_zone(ts, zone) -> Column:
    """Naive-UTC timestamp -> wall clock of ``zone`` (a literal or a per-row column)."""
    z = F.lit(zone) if isinstance(zone, str) and "/" in zone else _c(zone)
    return F.convert_timezone(F.lit("UTC"), z, _c(ts).cast("timestamp_ntz"))


def local_hour(ts, zone, default_zone: str = K.DEFAULT_ZONE) -> Column:
    """C2 + B15: hour in a per-row zone, default zone when the zone is unknown."""
    return F.hour(in_zone(ts, F.coalesce(_c(zone), F.lit(default_zone))))


def dow0(d) -> Column:
    """Day of week with 0 = Sunday."""
    return F.dayofweek(_c(d)) - 1


def season(month) -> Column:
    """Month number -> meteorological season."""
    m = _c(month)
    expr = None
    for mon, label in K.SEASONS:
        expr = F.when(m == mon, label) if expr is None else expr.when(m == mon, label)
    return expr.otherwise(K.SEASON_ELSE)


def hour_band(hour, bands=K.HOUR_BANDS, other: str = K.HOUR_BAND_ELSE) -> Column:
    """Hour -> named band; first matching inclusive range wins."""
    h = _c(hour)
    expr = None
    for lo, hi, label in bands:
        cond = h.between(lo, hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(other)


def cut_label(value, cuts: Sequence[tuple], last: str, inclusive: bool = False, cast: str | None = None) -> Column:
    """Ordered cut points -> label.  ``(cut, label)`` applies while value < cut
    (or <= cut when ``inclusive``); past the last cut the value gets ``last``."""
    v = _c(value)
    expr = None
    for cut, label in cuts:
        lit = F.lit(cut).cast(cast) if cast else F.lit(cut)
        cond = (v <= lit) if inclusive else (v < lit)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(last)


def era(ts, cuts=K.ERA_CUTS, last: str = K.ERA_LAST) -> Column:
    """Timestamp -> era; cuts are midnight UTC, open at the start."""
    return cut_label(_c(ts).cast("timestamp_ntz"), cuts, last, cast="timestamp_ntz")


def generation(birthday, cuts=K.GENERATION_CUTS, last: str = K.GENERATION_LAST) -> Column:
    """Birth year -> generation (inclusive upper bounds)."""
    return cut_label(F.year(_c(birthday)), cuts, last, inclusive=True)


def fixed_bin(x, width: int = K.AGE_BIN_YEARS) -> Column:
    """``floor(x / width) * width`` as an integer."""
    return (F.floor(_c(x) / F.lit(width)) * F.lit(width)).cast("int")


def days_between(start, end) -> Column:
    """Whole days from ``start`` to ``end`` (dates or timestamps, date part only)."""
    return F.datediff(F.to_date(_c(end)), F.to_date(_c(start)))


def age_years(birthday, ts) -> Column:
    """Age in fractional years at ``ts`` (days / 365.25)."""
    return days_between(birthday, ts) / F.lit(K.DAYS_PER_YEAR)


def election_day(year) -> Column:
    """C4: general-election date of ``year`` -- the Tuesday after the first Monday in November."""
    nov1 = F.make_date(_c(year).cast("int"), F.lit(11), F.lit(1))
    return F.date_add(nov1, ((F.lit(8) - dow0(nov1)) % 7 + 1).cast("int"))


def next_election(ts) -> Column:
    """The next general election on or after the UTC date of ``ts``.

    Odd years look at the following even year; once that year's election day has
    passed, the election two years later is next."""
    y = F.year(_c(ts))
    naive_year = y + (y % 2)
    naive = election_day(naive_year)
    return F.when(F.to_date(_c(ts)) > naive, election_day(naive_year + 2)).otherwise(naive)


def is_election_year(year) -> Column:
    """Even years."""
    return (_c(year) % 2) == 0


def is_presidential(year) -> Column:
    """Years divisible by four."""
    return (_c(year) % 4) == 0


def cycle_phase(days_to_election) -> Column:
    """0 just after an election, 1 on election day."""
    return F.lit(1.0) - _c(days_to_election) / F.lit(K.DAYS_PER_CYCLE)


def week_index(days) -> Column:
    """Integer week count from a day count (floor division, also for negatives)."""
    return F.floor(_c(days) / F.lit(7)).cast("int")


def week_start(ts) -> Column:
    """Monday of the (UTC) week as a DATE."""
    return F.date_trunc("week", _c(ts)).cast("date")


def month_start(ts) -> Column:
    """First of the (UTC) month as a DATE."""
    return F.date_trunc("month", _c(ts)).cast("date")


def month_label(d) -> Column:
    """``Jun 2020``."""
    return F.date_format(_c(d), "MMM yyyy")


def percent_text(p) -> Column:
    """0.374 -> ``37%`` (rounded half away from zero)."""
    return F.concat(F.round(_c(p) * 100).cast("long").cast("string"), F.lit("%"))
