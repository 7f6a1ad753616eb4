"""Severities from calibrated breaks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import SEVERITIES


def rank(severity: Column) -> Column:
    """0 for ok up to 3; names don't sort by weight."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1


def at_least(value: Column, bound: Column) -> Column:
    """False where there is no bound."""
    return F.coalesce(value >= bound, F.lit(False))


def classify(value: Column, p50: Column, p75: Column, p90: Column, p95: Column, critical: Column, ok: Column) -> Column:
    """Floors first; then nothing if the code base hardly varies (its upper half spreads less than
    half the band between the floors); then the breaks.  A null break or floor never applies."""
    narrow = F.coalesce((critical - ok > 0) & (p95 - p50 < (critical - ok) / 2), F.lit(False))
    return (
        F.when(at_least(value, critical), "critical")
        .when(F.coalesce(value < ok, F.lit(False)) | narrow, "ok")
        .when(at_least(value, p95), "critical")
        .when(at_least(value, p90), "high")
        .when(at_least(value, p75), "medium")
        .otherwise("ok")
    )


def hot(score: Column, p90: Column, ok: Column) -> Column:
    return ~F.coalesce(score < ok, F.lit(False)) & at_least(score, p90)


def ladder(value: Column, *steps: tuple[float, str]) -> Column:
    """The last step that the value reaches; ok below the first."""
    out = F.lit("ok")
    for bound, name in sorted(steps):
        out = F.when(value >= bound, name).otherwise(out)
    return out
