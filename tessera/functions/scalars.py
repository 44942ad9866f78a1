"""Scalar columns that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    name = ts if isinstance(ts, str) else None
    if name is None:
        raise TypeError("micros takes a column name")
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})")


def rounded(x: Column, digits: int = 6) -> Column:
    """For results: adding 0.0 turns a negative zero into zero."""
    return F.round(x.cast("double"), digits) + F.lit(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.when(b != 0, a.cast("double") / b)


def slog1p(x: Column) -> Column:
    """sign(x) * log(1 + |x|)."""
    return F.signum(x) * F.log1p(F.abs(x))


def xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def delta32(now: Column, before: Column) -> Column:
    """Increment of a counter of 32 bits: a wrap counts if the increment stays below 2**31, else it was reset."""
    diff, wrapped = now - before, now - before + F.lit(1 << 32)
    return F.when(diff >= 0, diff).when(wrapped < F.lit(1 << 31), wrapped)


def floor_div(x: str, width: int) -> Column:
    """floor(x / width) of whole numbers, exact and also right below zero."""
    return F.expr(f"(({x}) - pmod({x}, {width})) div {width}")


def ceil_div(x: str, width: int) -> Column:
    return floor_div(f"({x}) + {width - 1}", width)


def joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a with the other columns of b, where the keys are equal; a null key equals a null one."""
    if not keys:  # both sides are one group, b is its one row
        return a.join(F.broadcast(b), how=how, on=F.lit(True))
    other = b.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & a[k].eqNullSafe(other[f"__of_{k}"])
    return a.join(other, same, how).drop(*(f"__of_{k}" for k in keys))
