"""Distinct character k-grams of texts: their number and the sum of their hashes.

The work is local to the row: an Arrow kernel takes texts in stretches of
bounded size, packs each window into an integer and hashes each distinct
window of a stretch once.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions.shingles import MERSENNE_P
from ..session import ship

#: Characters that the kernel takes at once (one longer text goes by itself), and hashes that a task keeps.
STRETCH_CHARS, KEPT_HASHES = 1 << 21, 1 << 19


def window_keys(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A key of each window of k code points, equal if and only if the windows are, and the table that tells them back."""
    seen = np.zeros(int(codes.max(initial=0)) + 1, bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    place = np.cumsum(seen) - 1
    if len(alphabet) ** k >= 2 ** 63:  # too many kinds of characters to pack
        windows = np.lib.stride_tricks.sliding_window_view(codes, k)
        table, keys = np.unique(windows, axis=0, return_inverse=True)
        return keys.reshape(-1), table
    digits, n = place[codes].astype(np.int64), len(codes) - k + 1
    keys = np.zeros(n, np.int64)
    for j in range(k):
        keys = keys * len(alphabet) + digits[j:j + n]
    return keys, alphabet


def windows_of(keys: np.ndarray, table: np.ndarray, k: int) -> np.ndarray:
    """The code points, k a row, of keys from ``window_keys``."""
    if table.ndim == 2:
        return table[keys].astype(np.uint32)
    out = np.empty((len(keys), k), np.uint32)
    for j in range(k - 1, -1, -1):
        keys, digit = np.divmod(keys, len(table))
        out[:, j] = table[digit]
    return out


def hashes31(windows: np.ndarray, known: dict[bytes, int]) -> np.ndarray:
    """``portable_hash31`` of each row of code points; ``known`` keeps some for the next stretch."""
    k, raw = 4 * windows.shape[1], windows.tobytes()
    out = np.empty(len(windows), np.int64)
    for i in range(len(windows)):
        w = raw[k * i:k * (i + 1)]
        h = known.get(w)
        if h is None:
            if len(known) >= KEPT_HASHES:
                known.clear()
            h = known[w] = int.from_bytes(md5(w.decode("utf-32-le").encode(), usedforsecurity=False).digest()[:4], "big") % MERSENNE_P
        out[i] = h
    return out


def distinct_keys(keys: np.ndarray) -> np.ndarray:
    """Distinct keys, ascending: one plain sort."""
    keys = np.sort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new]


def sums_of(texts: list[str], k: int, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(number, sum of hashes) of the distinct windows of each text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    n = np.array([len(t) for t in texts], np.int64)
    number, sums = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    if n.max(initial=0) < k:
        return number, sums
    keys, table = window_keys(codes, k)
    found = []
    for i, (end, size) in enumerate(zip(np.cumsum(n).tolist(), n.tolist(), strict=True)):
        if size >= k:  # windows that begin in this text and end in it
            found.append(distinct_keys(keys[end - size:end - k + 1]))
            number[i] = len(found[-1])
    found = np.concatenate(found)
    distinct = distinct_keys(found)
    total = np.concatenate([[0], np.cumsum(hashes31(windows_of(distinct, table, k), known)[np.searchsorted(distinct, found)])])
    ends = np.cumsum(number)
    return number, total[ends] - total[ends - number]


def char_shingle_sums(texts: DataFrame, k: int = 5) -> DataFrame:
    """``texts(design_idx, text)`` -> (design_idx, n_shingles, shingle_checksum) over distinct runs of k characters."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            column, start = b.column(1), 0
            sizes = np.cumsum(np.asarray(pc.utf8_length(column)).astype(np.int64))
            while start < len(column):
                done = sizes[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, done + STRETCH_CHARS, "right")))
                number, sums = sums_of(column.slice(start, end - start).to_pylist(), k, known)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), pa.array(number, pa.int32()), pa.array(sums, pa.int64())],
                                                 names=["design_idx", "n_shingles", "shingle_checksum"])
                start = end

    return texts.mapInArrow(run, f"design_idx {texts.schema['design_idx'].dataType.simpleString()}, n_shingles int, shingle_checksum long")
