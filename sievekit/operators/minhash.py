"""MinHash signatures, band keys and signature-similarity joins.

Hash family (portable, so the DuckDB oracle reproduces it bit for bit):
``h(s) = int(md5(s)[:8], 16) mod P`` and ``perm_i(h) = (a_i*h + b_i) mod P``
with P = 2^31-1; all products fit in a signed 64-bit integer. Tokens, shingles
and hashes are JVM expressions; the minima over all permutations are an Arrow
kernel on the hash column. No step shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shingles import MERSENNE_P, portable_hash31
from ..session import ship

# FIXED VALUE: seed of the permutation parameters
PERM_SEED = 42


@lru_cache(maxsize=None)
def permutations(num_perm: int = 128, seed: int = PERM_SEED) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(a, b) parameters, a in [1, P), b in [0, P), from a seeded generator."""
    rng = np.random.RandomState(seed)
    a = rng.randint(1, MERSENNE_P, size=num_perm, dtype=np.int64)
    b = rng.randint(0, MERSENNE_P, size=num_perm, dtype=np.int64)
    return tuple(int(x) for x in a), tuple(int(x) for x in b)


def shingle_hashes31(shingles: Column) -> Column:
    return F.transform(shingles, portable_hash31)


#: Hashes that the kernel takes at once, so that its work arrays (one row a permutation) stay in the processor's cache.
KERNEL_HASHES = 512
#: Rows whose signatures a worker holds before it hands them on.
KERNEL_ROWS = 512


def signature_values(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of (a * h + b) mod P over a set's hashes, for all permutations."""
    least = np.full(len(a), MERSENNE_P, np.uint32)
    p, bits = np.uint64(MERSENNE_P), np.uint64(31)
    for i in range(0, len(hashes), KERNEL_HASHES):
        x = a[:, None] * hashes[None, i:i + KERNEL_HASHES].astype(np.uint64)
        x += b[:, None]
        high = x >> bits  # modulo 2^31 - 1: the high bits are added to the low ones, which gives less than 2 * P
        x &= p
        x += high
        low = x.astype(np.uint32)
        np.minimum(low, low - np.uint32(MERSENNE_P), out=low)  # of numbers below P the difference wraps to a larger one
        np.minimum(least, low.min(1), out=least)
    return least.astype(np.uint64)


def signatures(sets: DataFrame, num_perm: int = 128, seed: int = PERM_SEED) -> DataFrame:
    """``sets(id, hashes)`` -> (id, sig array<bigint>): num_perm minima; null for an empty (or null) set.

    The hashes are computed by the JVM in the same pass, whatever expression they are; batches of them go through an
    Arrow kernel, no rows.
    """
    ship(sets.sparkSession)
    params = [np.array(x, np.uint64) for x in permutations(num_perm, seed)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(i, KERNEL_ROWS) for batch in batches for i in range(0, batch.num_rows, KERNEL_ROWS)):
            hashes = b.column(1)
            ends = np.asarray(hashes.offsets)
            flat, n = np.asarray(hashes.values), np.where(np.asarray(hashes.is_valid()), np.diff(ends), 0)
            rows = [signature_values(flat[s:s + k], *params) for s, k in zip(ends[:-1].tolist(), n.tolist()) if k]
            starts = pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, num_perm, 0))]), pa.int32(), mask=np.append(n == 0, False))
            values = pa.array(np.concatenate([np.zeros(0, np.uint64), *rows]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(starts, values)], names=["id", "sig"])

    return sets.select("id", "hashes").mapInArrow(run, "id long, sig array<bigint>")


def matches(sig_a: Column, sig_b: Column) -> Column:
    """Number of equal positions of two signatures."""
    eq = F.zip_with(sig_a, sig_b, lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(eq, F.lit(0), lambda acc, x: acc + x)


# ---- band / row choice ----------------------------------------------------

def _integral(f, lo: float, hi: float, steps: int = 2000) -> float:
    xs = np.linspace(lo, hi, steps + 1)
    ys = f(xs)
    h = (hi - lo) / steps
    return float(h / 3 * (ys[0] + ys[-1] + 4 * ys[1:-1:2].sum() + 2 * ys[2:-1:2].sum()))


def optimal_bands(threshold: float, num_perm: int = 128,
                  fp_weight: float = 0.5, fn_weight: float = 0.5) -> tuple[int, int]:
    """(bands, rows) minimising the weighted false-positive and false-negative areas."""
    best, best_err = (1, 1), math.inf
    for b in range(1, num_perm + 1):
        for r in range(1, num_perm // b + 1):
            fp = _integral(lambda s: 1 - (1 - s ** r) ** b, 0.0, threshold)
            fn = _integral(lambda s: 1 - (1 - (1 - s ** r) ** b), threshold, 1.0)
            err = fp_weight * fp + fn_weight * fn
            if err < best_err:
                best, best_err = (b, r), err
    return best


def pigeonhole_bands(threshold: float, num_perm: int = 128) -> list[tuple[int, int]]:
    """Band (start, length) list such that any pair with estimate >= t agrees on one band.

    A pair with at least ceil(t*num_perm) equal positions differs on at most
    D = num_perm - ceil(t*num_perm) of them, so with D+1 disjoint bands at
    least one band is entirely equal: lossless candidates.
    """
    need = math.ceil(threshold * num_perm - 1e-9)
    parts = min(num_perm, num_perm - need + 1)
    base, extra = divmod(num_perm, parts)
    out, start = [], 1
    for i in range(parts):
        ln = base + (1 if i < extra else 0)
        out.append((start, ln))
        start += ln
    return out


def lsh_bands(bands: int, rows: int) -> list[tuple[int, int]]:
    return [(1 + i * rows, rows) for i in range(bands)]


def band_keys(df: DataFrame, sig_col: str, bands: list[tuple[int, int]],
              id_col: str = "id") -> DataFrame:
    """Long form (id, band, band_key): one row per band of every signature; 128-bit keys, as nothing verifies them."""
    keys = F.array(*[
        F.struct(F.lit(i).alias("band"), F.struct(F.xxhash64(F.slice(F.col(sig_col), s, ln)).alias("a"),
                                                  F.xxhash64(F.lit(1), F.slice(F.col(sig_col), s, ln)).alias("b")).alias("band_key"))
        for i, (s, ln) in enumerate(bands)])
    return (df.where(F.col(sig_col).isNotNull())
            .select(F.col(id_col).alias("id"), F.inline(keys)))


def signature_self_join(sigs: DataFrame, threshold: float, num_perm: int = 128,
                        bands: list[tuple[int, int]] | None = None,
                        id_col: str = "id", sig_col: str = "sig") -> DataFrame:
    """Pairs i < j with estimated Jaccard (equal positions / num_perm) >= threshold.

    Candidates come from band equality (pigeonhole bands by default: exact
    w.r.t. the estimate), then every candidate is verified on the signatures.
    """
    from .dedup import _checkpoint, shared_postings
    bands = bands or pigeonhole_bands(threshold, num_perm)
    s = _checkpoint(sigs.select(F.col(id_col).alias("id"), F.col(sig_col).alias("sig")).where(F.col("sig").isNotNull()))
    lists = shared_postings(band_postings(s, bands)).select("id", "tok")  # signatures alone in all their bands go no further
    a, b = lists.alias("a"), lists.alias("b")
    cand = (a.join(b, F.col("a.tok") == F.col("b.tok")).where(F.col("a.id") < F.col("b.id"))
            .select(F.col("a.id").alias("i"), F.col("b.id").alias("j")).distinct())
    left = s.select(F.col("id").alias("i"), F.col("sig").alias("sig_i"))
    right = s.select(F.col("id").alias("j"), F.col("sig").alias("sig_j"))
    est = matches(F.col("sig_i"), F.col("sig_j")) / F.lit(float(num_perm))
    return (cand.join(left, "i").join(right, "j")
            .withColumn("similarity", est)
            .where(F.col("similarity") >= F.lit(float(threshold)))
            .select("i", "j", "similarity"))


def band_postings(sigs: DataFrame, bands: list[tuple[int, int]], id_col: str = "id",
                  sig_col: str = "sig") -> DataFrame:
    """Posting lists ``(id, n, tok)`` over band keys (``tok`` = 64-bit key of (band, key))."""
    keys = band_keys(sigs.select(F.col(id_col).alias("id"), F.col(sig_col).alias("sig")), "sig", bands)
    return keys.select("id", F.lit(0).alias("n"), F.xxhash64("band", "band_key").alias("tok"))


def signature_verifier(num_perm: int = 128):
    """``verify(pairs, docs, t, a, b)`` on signatures stored in ``docs(id, set)``."""
    def verify(pairs: DataFrame, docs: DataFrame, t: float, a: str = "a", b: str = "b") -> DataFrame:
        left = docs.select(F.col("id").alias(a), F.col("set").alias("_sa"))
        right = docs.select(F.col("id").alias(b), F.col("set").alias("_sb"))
        est = matches(F.col("_sa"), F.col("_sb")) / F.lit(float(num_perm))
        return (pairs.join(left, a).join(right, b).withColumn("sim", est)
                .where(F.col("sim") >= F.lit(float(t))).drop("_sa", "_sb"))
    return verify
