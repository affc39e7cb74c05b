"""Measures of keyword association from a smoothed two-by-two table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def df_threshold(total: Column, ratio: float = 0.2, floor: int = 8) -> Column:
    """Most events a keyword may have: max(floor, ceil(ratio * total)); no limit (0) without events."""
    limit = F.ceil(total * F.lit(ratio)) if ratio > 0 else total
    return F.when(total > 0, F.greatest(F.lit(floor).cast("bigint"), limit.cast("bigint"))).otherwise(F.lit(0).cast("bigint"))


def pair_signal(total: Column, c1: Column, c2: Column, c12: Column, smoothing: float = 0.5) -> dict[str, Column]:
    """npmi, pmi, log_odds, lift_raw, lift_smoothed and expected_count; zero where undefined."""
    a = c12 + F.lit(smoothing)
    b = F.greatest(c1 - c12, F.lit(0)) + F.lit(smoothing)
    c = F.greatest(c2 - c12, F.lit(0)) + F.lit(smoothing)
    d = F.greatest(total - c1 - c2 + c12, F.lit(0)) + F.lit(smoothing)
    n = a + b + c + d
    ok = (total > 0) & (a > 0)
    lift = F.when(ok & (a + b > 0) & (a + c > 0), (a / n) / (((a + b) / n) * ((a + c) / n))).otherwise(F.lit(0.0))
    pmi = F.when(lift > 0, F.log(lift)).otherwise(F.lit(0.0))
    bits = F.when(ok & (a < n), -F.log(a / n))
    return {
        "npmi": F.when(bits > 0, pmi / bits).otherwise(F.lit(0.0)),
        "pmi": pmi,
        "log_odds": F.when((total > 0) & (a > 0) & (b > 0) & (c > 0) & (d > 0), F.log((a * d) / (b * c))).otherwise(F.lit(0.0)),
        "lift_raw": F.when((total > 0) & (c1 > 0) & (c2 > 0), c12 * total / (c1 * c2)).otherwise(F.lit(0.0)),
        "lift_smoothed": F.when(total > 0, lift).otherwise(F.lit(0.0)),
        "expected_count": F.when(total > 0, c1 * c2 / total).otherwise(F.lit(0.0)),
    }
