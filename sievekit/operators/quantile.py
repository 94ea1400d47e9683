"""Exact quantiles of many columns by narrowing ranges, without sorting and without a task that holds a column's values.

A pass counts, for every range that still holds a wanted rank, its values in
``BUCKETS`` buckets, with the least and the largest value of each. The bucket
of a rank is its next range; when its least and largest value are the same, or
when it holds ``FEW`` values at most, the rank is found. Buckets are equal
parts of a range in the values' own scale and in that of their logarithms by
turns, both of which keep the order of the values, so that clustered and wide
columns narrow alike. All columns and ranks share each pass: one scan with a
partial aggregate of at most ``BUCKETS`` groups a range. Few passes are needed
(two for most columns); the driver gets bounded counts.

Quantiles are interpolated linearly between the two ranks around them. Nulls
and NaN are left out; a column without values has no quantiles (None).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, FEW = 1024, 256


@dataclass(frozen=True)
class Range:
    """Values of a column from ``lo`` to ``hi``, of which ``before`` others are smaller."""
    col: str
    lo: float
    hi: float
    before: int


def _log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def _bucket(x: Column, r: Range, logarithmic: bool) -> Column:
    """Number of the bucket of a value of the range; it never falls as the value grows."""
    scale = _log if logarithmic else (lambda c: c)
    lo, hi = scale(F.lit(r.lo)), scale(F.lit(r.hi))
    half = F.lit(0.5)  # halves first: the range may be wider than a double
    part = (scale(x) * half - lo * half) / (hi * half - lo * half)
    return F.least(F.floor(part * F.lit(float(BUCKETS))).cast("int"), F.lit(BUCKETS - 1))


def _ranks(n: int, probs: list[float]) -> set[int]:
    return {k for p in probs for k in (math.floor((n - 1) * p), min(math.floor((n - 1) * p) + 1, n - 1))}


def _counts(df: DataFrame, ranges: list[Range], logarithmic: bool) -> dict[int, list]:
    """By range: (bucket, values, least, largest) in order."""
    found = [F.when(F.col(f"`{r.col}`").cast("double").between(r.lo, r.hi), F.struct(
        F.lit(i).alias("i"), _bucket(F.col(f"`{r.col}`").cast("double"), r, logarithmic).alias("b"), F.col(f"`{r.col}`").cast("double").alias("x")))
        for i, r in enumerate(ranges)]
    rows = (df.select(F.explode(F.array_compact(F.array(*found))).alias("v")).groupBy("v.i", "v.b")
            .agg(F.count("*").alias("n"), F.min("v.x").alias("lo"), F.max("v.x").alias("hi")).collect())
    out: dict[int, list] = {i: [] for i in range(len(ranges))}
    for r in rows:
        out[r.i].append((r.b, r.n, r.lo, r.hi))
    return {i: sorted(v) for i, v in out.items()}


def _values(df: DataFrame, ranges: list[Range]) -> dict[int, list[float]]:
    """By range: its values in order; a range holds FEW values at most, or one that repeats."""
    found = [F.when(F.col(f"`{r.col}`").cast("double").between(r.lo, r.hi), F.struct(F.lit(i).alias("i"), F.col(f"`{r.col}`").cast("double").alias("x")))
             for i, r in enumerate(ranges)]
    rows = df.select(F.explode(F.array_compact(F.array(*found))).alias("v")).groupBy("v.i", "v.x").agg(F.count("*").alias("n")).collect()
    out: dict[int, list[float]] = {i: [] for i in range(len(ranges))}
    for r in sorted(rows, key=lambda r: r.x):
        out[r.i] += [r.x] * r.n
    return out


def quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float] | None]:
    """Exact quantiles of numeric columns; ``df`` is read once a pass, so it should be a written or cached table."""
    x = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in cols}
    first = df.agg(*(f(x[c]).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max)))).first()
    size = {c: first[f"n{i}"] for i, c in enumerate(cols)}
    got: dict[str, dict[int, float]] = {c: {} for c in cols}
    todo = {Range(c, first[f"lo{i}"], first[f"hi{i}"], 0): sorted(_ranks(size[c], probs)) for i, c in enumerate(cols) if size[c]}
    few: dict[Range, list[int]] = {}
    logarithmic = False
    while todo:
        for r in [r for r in todo if r.lo == r.hi]:
            got[r.col] |= dict.fromkeys(todo.pop(r), r.lo)
        ranges = list(todo)
        nxt: dict[Range, list[int]] = {}
        for i, buckets in (_counts(df, ranges, logarithmic) if ranges else {}).items():
            before, ranks = ranges[i].before, list(todo[ranges[i]])
            for _, n, lo, hi in buckets:
                mine = [k for k in ranks if k < before + n]
                if mine:
                    (few if n <= FEW and lo != hi else nxt).setdefault(Range(ranges[i].col, lo, hi, before), []).extend(mine)
                    ranks = ranks[len(mine):]
                before += n
        todo, logarithmic = nxt, not logarithmic
    ranges = list(few)
    for i, values in (_values(df, ranges) if ranges else {}).items():
        got[ranges[i].col] |= {k: values[k - ranges[i].before] for k in few[ranges[i]]}

    def at(c: str, p: float) -> float:
        place = (size[c] - 1) * p
        k = math.floor(place)
        a, b = got[c][k], got[c][min(k + 1, size[c] - 1)]
        return a + (b - a) * (place - k) if place > k else a

    return {c: [at(c, p) for p in probs] if size[c] else None for c in cols}
