"""k-shingles and hashes of shingles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUE: Mersenne prime of the portable MinHash family
MERSENNE_P = 2147483647


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Expressions referenced inside a higher-order lambda are re-evaluated per
    element; binding the token array first keeps tokenisation O(n), not O(n^2).
    """
    return F.transform(F.array(value), body).getItem(0)


def _shingles_of(tokens: Column, k: int, sep: str) -> Column:
    n = F.size(tokens)
    grams = F.transform(F.sequence(F.lit(1), n - k + 1),
                        lambda i: F.array_join(F.slice(tokens, i, k), sep))
    return F.when(n >= k, F.array_distinct(grams)).otherwise(
        F.array().cast("array<string>"))


def shingles(tokens: Column, k: int = 5, sep: str = " ") -> Column:
    """Distinct k consecutive tokens joined by ``sep``; empty when fewer than k tokens."""
    return let(tokens, lambda t: _shingles_of(t, k, sep))


def shingle_keys64(tokens: Column, k: int = 5) -> Column:
    """Distinct 64-bit keys of the k-token windows, hashed straight from the token
    slices (no shingle strings are built). Tokens never contain the separator,
    so a window and its joined shingle identify each other: same set semantics."""
    def keys(t: Column) -> Column:
        n = F.size(t)
        return F.when(n >= k, F.array_distinct(F.transform(
            F.sequence(F.lit(1), n - k + 1), lambda i: F.xxhash64(F.slice(t, i, k))))
        ).otherwise(F.array().cast("array<bigint>"))
    return let(tokens, keys)


def portable_hash31(s: Column) -> Column:
    """First 8 hex digits of md5 modulo 2^31-1: identical in Spark and DuckDB."""
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint") % F.lit(MERSENNE_P)
