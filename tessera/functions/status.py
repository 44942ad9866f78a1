"""Observation status: why a value is there or not. An excluded value is NULL, never zero and never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed codes.
STATUSES = ("OBSERVED", "STALE", "LOW_RELIABILITY", "NOT_SUPPLIED", "NOT_OBSERVABLE")
OBSERVED, STALE, LOW_RELIABILITY, NOT_SUPPLIED, NOT_OBSERVABLE = range(5)
CONTRIBUTING = (OBSERVED, STALE, LOW_RELIABILITY)


def contributes(status: Column) -> Column:
    return status.isin(*CONTRIBUTING)


def status_name(status: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATUSES)), status.cast("int") + 1)


def present(value: Column, status: Column) -> Column:
    """The value where it contributes, else NULL."""
    return F.when(contributes(status), value)


def weight(status: Column, weights: dict[int, float]) -> Column:
    """The evidence weight of each status; excluded ones weigh nothing."""
    out = F.lit(0.0)
    for code in CONTRIBUTING:
        out = F.when(status == code, F.lit(float(weights.get(code, 1.0)))).otherwise(out)
    return out
