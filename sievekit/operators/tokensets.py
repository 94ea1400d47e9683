"""Sets of distinct k-token windows that are made again from compactly written tokens wherever they are read.

A set has 8 bytes a window that no codec shortens, so a written or shuffled copy of all sets is larger than the texts.
Tokens repeat: written as 64-bit keys in order, Parquet's dictionary and codec bring them to a byte or two each, and
an Arrow kernel makes a row's windows from them in microseconds. So tokens are written once, with the size and a
128-bit key of each row's set; every other step reads them again, and only prefixes and the tokens of candidates are shuffled,
the tokens packed: two bytes for each of the commonest, and a set's windows are made where it is compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, shuffles_freed
from .dedup import _checkpoint
from .simjoin import prefix_arrays, sort_rows, token_sketch

#: FIXED VALUE: multiplier of the keys of windows (any odd number).
WINDOW_MULTIPLIER = 0x9E3779B97F4A7C15
#: Tokens of a stretch of rows that a kernel handles at once.
STRETCH_TOKENS = 500_000
#: Distinct tokens' bytes that a written part may hold as a dictionary.
DICTIONARY_BYTES = 16 << 20
#: Bits of the filter that tells the rows of wanted ids, at most (a power of two; 4 MB).
FILTER_BITS = 25
#: Commonest tokens that a packed row names by a 16-bit code; this code itself stands for a token whose key follows.
CODES = (1 << 16) - 1
#: Tokens that a task holds at most before it counts them.
COUNTED_TOKENS = 4_000_000


def window_keys(tokens: np.ndarray, k: int) -> np.ndarray:
    """The key of every ``k`` consecutive token keys: a sum with powers of an odd number, modulo 2^64."""
    n = max(0, len(tokens) - k + 1)
    tokens, key, factor = tokens.view(np.uint64), np.zeros(n, np.uint64), 1
    for i in range(k):
        key += tokens[i:i + n] * np.uint64(factor)
        factor = factor * WINDOW_MULTIPLIER % (1 << 64)
    return key.view(np.int64)


def _stretches(lists: pa.ListArray, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, sets, ends) of stretches of a column of token lists: the rows' sets one after another, each sorted.

    Windows are made over a stretch at once; those that reach into the next row are left out.
    """
    ends = np.asarray(lists.offsets)
    values = np.asarray(lists.values)
    start = 0
    while start < len(lists):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + STRETCH_TOKENS, "right")) - 1)
        cuts = ends[start:stop + 1].astype(np.int64) - ends[start]
        sizes = np.maximum(np.diff(cuts) - k + 1, 0)
        at = np.concatenate([[0], np.cumsum(sizes)])
        places = np.arange(at[-1]) + np.repeat(cuts[:-1] - at[:-1], sizes)  # where the windows begin
        sets = sort_rows(window_keys(values[ends[start]:ends[stop]], k)[places], list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)))
        new = np.ones(len(sets), bool)
        new[1:] = sets[1:] != sets[:-1]
        new[at[:-1][sizes > 0]] = True
        yield start, stop, sets[new], np.concatenate([[0], np.cumsum(new)])[at]
        start = stop


def _described_rows(k: int):
    """(id, toks) rows with the size and the key of their set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop, sets, ends in _stretches(b.column(1), k):
                keys = [hashlib.md5(sets[i:j]).digest() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.slice(start, stop - start).columns, pa.array(np.diff(ends), pa.int32()), pa.array(keys, pa.binary())],
                                                 names=["id", "toks", "n", "key"])
    return run


def _id_slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return (ids.view(np.uint64) * np.uint64(WINDOW_MULTIPLIER)) >> np.uint64(64 - bits)


def _set_rows(k: int, sent, inside: bool):
    """(id, toks, n, key) rows to (id, set, n, key); ``sent``: a filter of the ids wanted, or (not ``inside``) unwanted, or None."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = _wanted(b, sent, inside)
            for start, stop, sets, ends in _stretches(b.column(1), k):
                few = b.slice(start, stop - start)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sets))
                yield pa.RecordBatch.from_arrays([few.column(0), lists, few.column(2), few.column(3)], names=["id", "set", "n", "key"])
    return run


def _wanted(b: pa.RecordBatch, sent, inside: bool = True) -> pa.RecordBatch:
    """The rows whose id (first column) the filter ``sent`` holds, or (not ``inside``) does not; all if it is None."""
    if sent is None:
        return b
    words = sent.value
    at = _id_slots(b.column(0).to_numpy(), len(words).bit_length() + 5)
    hit = (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
    return b.filter(pa.array(hit.astype(bool) == inside))


def _common_rows(sent):
    """(id, toks) rows with a wanted id to (token, times) of a task's commonest tokens, a bounded number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, held = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def count() -> None:
            nonlocal keys, times
            more, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            held.clear()
            keys, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
            times = np.bincount(at, np.concatenate([times, n]), len(keys)).astype(np.int64)
            if len(keys) > 2 * CODES:
                top = np.argpartition(-times, 2 * CODES)[:2 * CODES]
                keys, times = keys[top], times[top]

        for b in batches:
            held.append(np.asarray(_wanted(b, sent).column(1).flatten()))
            if sum(map(len, held)) >= COUNTED_TOKENS:
                count()
        count()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], names=["token", "times"])
    return run


def common_tokens(rows: DataFrame, sent) -> np.ndarray:
    """The commonest token keys of ``rows(id, toks)`` with a wanted id, sorted, ``CODES`` at most. Any choice packs without loss."""
    few = 2 * rows.sparkSession.sparkContext.defaultParallelism
    with shuffles_freed(rows.sparkSession):
        found = (rows.select("id", "toks").coalesce(few).mapInArrow(_common_rows(sent), "token long, times long")
                 .groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(CODES).select("token").toArrow())
    return np.sort(found.column("token").to_numpy())


def _packed_rows(sent, common):
    """(id, toks, n, key) rows with a wanted id to (id, packed, n, key): the number of tokens, their codes, the keys of those without one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common.value
        for b in batches:
            b = _wanted(b, sent)
            lists = b.column(1)
            ends = np.asarray(lists.offsets).astype(np.int64)
            ends, flat = ends - ends[0], np.asarray(lists.flatten())
            at = np.searchsorted(table, flat)
            at[at == len(table)] = 0
            known = table[at] == flat if len(table) else np.zeros(len(flat), bool)
            codes, rest = np.where(known, at, CODES).astype("<u2"), flat[~known].astype("<i8")
            after = np.concatenate([[0], np.cumsum(~known)])[ends].tolist()
            ends = ends.tolist()
            packed = [(z - a).to_bytes(4, "little") + codes[a:z].tobytes() + rest[c:d].tobytes()
                      for a, z, c, d in zip(ends, ends[1:], after, after[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary()), b.column(2), b.column(3)], names=["id", "packed", "n", "key"])
    return run


def _unpacked(rows: list[bytes], table: np.ndarray) -> pa.ListArray:
    """The tokens of packed rows; ``table`` has a key for each code."""
    sizes = [int.from_bytes(r[:4], "little") for r in rows]
    codes = np.concatenate([np.zeros(0, "<u2"), *(np.frombuffer(r, "<u2", m, 4) for r, m in zip(rows, sizes))])
    rest = np.concatenate([np.zeros(0, "<i8"), *(np.frombuffer(r, "<i8", -1, 4 + 2 * m) for r, m in zip(rows, sizes) if len(r) > 4 + 2 * m)])
    toks = table[codes]
    toks[codes == CODES] = rest
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(toks, pa.int64()))


def _opened_rows(k: int, common):
    """Rows with ``packed`` to rows with ``set`` in its place, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CODES + 1, np.int64)
        table[:len(common.value)] = common.value
        for b in batches:
            where = b.schema.get_field_index("packed")
            rows = b.column(where).to_pylist()
            size, first = 0, 0
            for i, r in enumerate(rows):
                size += int.from_bytes(r[:4], "little")
                if size < STRETCH_TOKENS and i + 1 < len(rows):
                    continue
                part = b.slice(first, i + 1 - first)
                for start, stop, sets, ends in _stretches(_unpacked(rows[first:i + 1], table), k):
                    few = part.slice(start, stop - start)
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sets))
                    yield pa.RecordBatch.from_arrays([lists if c == where else few.column(c) for c in range(few.num_columns)],
                                                     names=["set" if c == "packed" else c for c in few.schema.names])
                size, first = 0, i + 1
    return run


def id_filter(ids: DataFrame) -> np.ndarray:
    """64-bit words with the bit of each id's slot set: ``2 ** FILTER_BITS`` bits at most, whatever the number of ids."""
    ids = ids.select(F.col(ids.columns[0]).cast("long").alias("id"))
    with shuffles_freed(ids.sparkSession):
        bits = min(FILTER_BITS, max(10, ids.count().bit_length() + 4))
    ship(ids.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << (bits - 6), np.uint64)
        for b in batches:
            at = _id_slots(b.column(0).to_numpy(), bits)
            np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used].view(np.int64))], names=["word", "bits"])

    with shuffles_freed(ids.sparkSession):
        found = ids.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


@dataclass
class PackedSets:
    """Rows ``table(id, packed, n)`` that are shuffled as they are and opened where their sets are compared."""

    table: DataFrame
    common: Broadcast
    k: int

    def opened(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the sorted ``set`` in place of ``packed``, in order."""
        ship(rows.sparkSession)
        columns = ("set array<bigint>" if f.name == "packed" else f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(_opened_rows(self.k, self.common), ", ".join(columns))


@dataclass
class TokenSets:
    """Distinct k-token windows of every row of ``table(id, toks, n, key)``; ``n`` is a set's size, equal sets have equal keys."""

    table: DataFrame
    k: int

    def __post_init__(self):
        self.valid = self.table.where("n > 0").select("id", "n", "key")  # rows with a window

    def _tokens(self) -> DataFrame:
        """(id, toks, n, key) of the rows with a window."""
        ship(self.table.sparkSession)
        return self.table.where("n > 0").select(F.col("id").cast("long").alias("id"), "toks", "n", "key")

    def rows(self, wanted=None, inside: bool = True) -> DataFrame:
        """(id, set, n, key) of the rows with a window; with a broadcast ``id_filter`` those inside or outside it."""
        return self._tokens().mapInArrow(_set_rows(self.k, wanted, inside), "id long, set array<bigint>, n int, key binary")

    def _sent(self, ids: DataFrame):
        return ids.sparkSession.sparkContext.broadcast(id_filter(ids))

    def representatives(self) -> DataFrame:
        """(rep, n, key): the least id of the rows of each set."""
        return self.valid.groupBy("n", "key").agg(F.min("id").alias("rep"))

    def members(self) -> DataFrame:
        """(id, rep) of every row with a window."""
        return self.valid.join(self.representatives(), ["n", "key"]).select("id", "rep")

    def prefixes(self, t: float) -> DataFrame:
        """(id, n, pos, tok) prefix rows of the representatives.

        Rows outside the filter of rows that share their set are representatives; the prefixes of the others are
        grouped by set, where copies meet in a partial aggregate.
        """
        tokens = self.valid.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
        sketch = token_sketch(self.rows(), tokens)
        shared = self.valid.groupBy("n", "key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("n", "key")
        sent = self._sent(self.valid.join(shared, ["n", "key"]).select("id"))
        once = prefix_arrays(self.rows(sent, False), t, sketch).select("id", "n", "prefix")
        more = (prefix_arrays(self.rows(sent), t, sketch, "key").groupBy("n", "key")
                .agg(F.min("id").alias("id"), F.first("prefix").alias("prefix")).select("id", "n", "prefix"))
        return once.unionByName(more).select("id", "n", F.posexplode("prefix").alias("pos", "tok"))

    def of_representatives(self, ids: DataFrame) -> PackedSets:
        """The representatives among ``ids(id)``, packed and dealt by id: one shuffle of their tokens."""
        sent = self._sent(ids)
        common = self.table.sparkSession.sparkContext.broadcast(common_tokens(self._tokens(), sent))
        packed = self._tokens().mapInArrow(_packed_rows(sent, common), "id long, packed binary, n int, key binary")
        reps = (self.representatives().withColumnRenamed("rep", "id").join(ids.select("id").distinct(), "id", "left_semi")
                .groupBy("id").agg(F.collect_list(F.struct("n", "key")).alias("sets")))
        # an id can come with several sets, and more than once with each
        once = (packed.join(reps, "id").where(F.array_contains("sets", F.struct("n", "key")))
                .groupBy("id", "n", "key").agg(F.first("packed").alias("packed")))
        return PackedSets(once.select("id", "packed", "n"), common, self.k)


def token_sets(tokens: DataFrame, k: int) -> TokenSets:
    """``tokens(id, tokens array<string>)`` as written ``TokenSets``; null tokens are none."""
    ship(tokens.sparkSession)
    keys = F.transform(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: F.xxhash64(t))
    rows = tokens.select(F.col("id").cast("long").alias("id"), keys.alias("toks")).mapInArrow(
        _described_rows(k), "id long, toks array<bigint>, n int, key binary")
    return TokenSets(_checkpoint(rows, {"compression": "zstd", "parquet.dictionary.page.size": DICTIONARY_BYTES}), k)
