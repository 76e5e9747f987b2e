"""Order keys packed into one decimal, for arg-max and arg-min without sorting.

``max_by`` and ``max(struct(...))`` keep a buffer that Spark cannot update in place, so they run
as a SortAggregate, which sorts every row by the group. A ``decimal(38, 0)`` it can: the maximum of
(time, id) or (score, id) as one number runs as a HashAggregate, and both parts are read from the
winner. Parts are exact; a pair that does not fit is an overflow error in ANSI mode, never a
wrong order.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "decimal(38,0)"
#: 2**64 and 2**63: the second part is a 64-bit id, moved to 0 and up.
_BASE, _HALF = "18446744073709551616", "9223372036854775808"
#: Exponents of doubles are counted from the smallest subnormal one.
_LOWEST = 1075
_MANTISSA = 1 << 52


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _wide(text: str) -> Column:
    return F.lit(text).cast(_WIDE)


def pack(first, second) -> Column:
    """Two longs as one number, ordered by ``first``, then ``second``; null if either is null.
    ``first`` may be up to 5.4e18 in size (any timestamp in microseconds; see :func:`ordinal`)."""
    return _c(first).cast("long").cast("decimal(19,0)") * F.lit(_BASE).cast("decimal(20,0)") + (
        _c(second).cast("long").cast("decimal(20,0)") + F.lit(_HALF).cast("decimal(20,0)"))


def _unsigned_second(packed) -> Column:
    p = _c(packed)
    return F.pmod(p, F.lit(_BASE).cast("decimal(20,0)"))


def second(packed) -> Column:
    """The second part of a packed pair."""
    return (_unsigned_second(packed).cast("decimal(21,0)") - F.lit(_HALF).cast("decimal(20,0)")).cast("long")


def first(packed) -> Column:
    """The first part of a packed pair."""
    return F.call_function("div", _c(packed) - _unsigned_second(packed), F.lit(_BASE).cast("decimal(20,0)"))


def newest(ts, tie) -> Column:
    """(time, id): its maximum is the last row, ties to the largest id. Null without a time."""
    return pack(F.unix_micros(_c(ts).cast("timestamp")), tie)


def ordinal(x) -> Column:
    """A long that orders like the double ``x``: sign, exponent, mantissa. Zeros are 0, NaN is above
    every number. Sizes up to that of a float (3.4e38) fit into :func:`pack`."""
    a = F.abs(_c(x).cast("double"))
    e0 = F.floor(F.log2(a))
    m0 = a / F.pow(F.lit(2.0), e0)
    # the logarithm may round across a power of two: the quotient, which is exact, says so
    e = F.when(m0 >= 2, e0 + 1).when(m0 < 1, e0 - 1).otherwise(e0).cast("long")
    m = a / F.pow(F.lit(2.0), e.cast("double"))
    size = (e + _LOWEST) * F.lit(_MANTISSA) + ((m - 1) * float(_MANTISSA)).cast("long")
    return (F.when(F.isnan(_c(x)), F.lit((_LOWEST + 128) * _MANTISSA - 1)).when(_c(x) == 0, F.lit(0))
            .when(_c(x) > 0, size).otherwise(-size))


def from_ordinal(n) -> Column:
    """The double whose :func:`ordinal` is ``n``."""
    a = F.abs(_c(n))
    e = F.shiftright(a, 52)
    m = F.lit(1.0) + (a - F.shiftleft(e, 52)).cast("double") / float(_MANTISSA)
    size = m * F.pow(F.lit(2.0), (e - _LOWEST).cast("double"))
    return (F.when(_c(n) == 0, F.lit(0.0)).when(a == (_LOWEST + 128) * _MANTISSA - 1, F.lit(float("nan")))
            .when(_c(n) > 0, size).otherwise(-size))


def highest(score, tie) -> Column:
    """(score, -id): its maximum is the row with the highest score, ties to the smallest id.
    Null without a score. Ids are longs other than the smallest one."""
    return F.when(_c(score).isNotNull(), pack(ordinal(score), -_c(tie).cast("long")))


def highest_id(packed) -> Column:
    return -second(packed)


def highest_score(packed) -> Column:
    return from_ordinal(first(packed))
