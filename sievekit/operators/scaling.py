"""Column scalers; the fitted statistics are a bounded result (3 numbers per
column), applied as literals - the same shape as a fitted MLlib scaler model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantile import quantiles


def fit_robust(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """(median, divisor) per column; divisor = IQR, or 1 when the IQR is 0. Exact quantiles, interpolated linearly."""
    out = {}
    for c, found in quantiles(df, cols, [0.25, 0.5, 0.75]).items():
        q1, med, q3 = found or (0.0, 0.0, 0.0)
        out[c] = (med, q3 - q1 if q3 != q1 else 1.0)
    return out


def apply_robust(df: DataFrame, stats: dict[str, tuple[float, float]], keep: list[str] | None = None) -> DataFrame:
    keep = keep or [c for c in df.columns if c not in stats]
    return df.select(*keep, *[((F.col(c) - F.lit(m)) / F.lit(d)).alias(c) for c, (m, d) in stats.items()])


def robust_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    return apply_robust(df, fit_robust(df, cols))


def fit_maxabs(df: DataFrame, cols: list[str]) -> dict[str, float]:
    row = df.agg(*[F.max(F.abs(F.col(c))).alias(c) for c in cols]).first()
    return {c: (float(row[c]) if row[c] not in (None, 0) else 1.0) for c in cols}


def maxabs_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    s = fit_maxabs(df, cols)
    keep = [c for c in df.columns if c not in s]
    return df.select(*keep, *[(F.col(c) / F.lit(d)).alias(c) for c, d in s.items()])
