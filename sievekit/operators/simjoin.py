"""Exact Jaccard self-join on set columns (prefix filter + length filter).

Lossless for threshold t > 0 (Chaudhuri et al. 2006, Bayardo et al. 2007,
Xiao et al. 2008, Vernica et al. 2010): order every set by one global order of
the tokens; two sets with J >= t share a token inside both prefixes of
length ``|x| - ceil(t|x|) + 1``. Frequent tokens (boilerplate) sort last and
so rarely enter a prefix, which keeps hot posting lists out of the join.

Physical plan: a bounded sketch of token counts
-> row-local prefixes with positions -> prefix self-join on token (AQE splits
skewed tokens) -> pairs, each with its common prefix tokens and the last of
their positions, which bound the overlap -> verify those that can reach the
threshold on the full sorted sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-9
#: The sketch that orders tokens has so many counters at most (powers of two), handed on in pieces of so many.
SKETCH_BITS, SKETCH_PIECE_BITS = 24, 16


def min_overlap_size(n: Column, t: float) -> Column:
    """Smallest partner size a set of size n can have at Jaccard >= t."""
    return F.ceil(F.lit(t) * n - F.lit(EPS))


def prefix_length(n: Column, t: float) -> Column:
    return n - min_overlap_size(n, t) + 1


def collapse_equal_sets(sets: DataFrame, id_col: str = "id", set_col: str = "set"):
    """Group byte-equal sets; return (representatives, members).

    ``representatives`` (id, set) keeps the smallest id of every group;
    ``members`` (id, rep) maps every id to its representative. The group key
    is (size, 128-bit hash of the sorted set); the aggregation is partial, so a group
    of copies holding a large share of the rows is combined map-side.
    """
    keyed = sets.select(
        F.col(id_col).alias("id"), F.col(set_col).alias("set"),
        F.size(set_col).alias("n"),
        F.struct(F.xxhash64(F.array_sort(F.col(set_col))).alias("a"),
                 F.xxhash64(F.lit(1), F.array_sort(F.col(set_col))).alias("b")).alias("set_key"))
    reps = (keyed.groupBy("n", "set_key")
            .agg(F.min("id").alias("rep"), F.min_by("set", "id").alias("set")))
    members = keyed.select("id", "n", "set_key").join(
        reps.select("n", "set_key", "rep"), ["n", "set_key"]).select("id", "rep")
    return reps.select(F.col("rep").alias("id"), "set"), members


def jaccard_self_join(sets: DataFrame, threshold: float, id_col: str = "id",
                      set_col: str = "set", prefix: DataFrame | None = None) -> DataFrame:
    """All pairs i < j of non-empty sets with |i & j| / |i | j| >= threshold.

    Returns ``(i, j, overlap, jaccard)``. Sets must hold distinct elements.
    """
    if not 0.0 < threshold <= 1.0:
        raise ValueError("threshold must be in (0, 1]")
    t = float(threshold)
    docs = (sets.select(F.col(id_col).alias("id"), F.col(set_col).alias("set"))
            .withColumn("n", F.size("set")).where(F.col("n") > 0))
    if prefix is None:  # read several times each
        from .dedup import _checkpoint
        docs = _checkpoint(docs)
        prefix = _checkpoint(prefix_table(docs, t))
    return similar_pairs(candidate_pairs(prefix, t), docs, t)


def similar_pairs(cand: DataFrame, docs: DataFrame, t: float) -> DataFrame:
    """(i, j, overlap, jaccard) of the candidates (i, j) whose sets in ``docs(id, set, n)`` have Jaccard >= t."""
    left = docs.select(F.col("id").alias("i"), F.col("set").alias("set_i"), F.col("n").alias("n_i"))
    right = docs.select(F.col("id").alias("j"), F.col("set").alias("set_j"), F.col("n").alias("n_j"))
    ver = (cand.join(left, "i").join(right, "j")
           .withColumn("overlap", F.size(F.array_intersect("set_i", "set_j")))
           .withColumn("jaccard", F.col("overlap") / (F.col("n_i") + F.col("n_j") - F.col("overlap")))
           .where(F.col("jaccard") >= F.lit(t)))
    return ver.select("i", "j", "overlap", "jaccard")


def candidate_pairs(prefix: DataFrame, t: float) -> DataFrame:
    """Pairs (i, j) of ``prefix(id, n, pos, tok)`` that share a prefix token, have sizes and can have the overlap for Jaccard >= t.

    After its last common prefix token a pair can share the rest of the smaller remainder at most, so its common
    tokens plus that remainder bound the overlap; so do they with what lies behind the prefix (``within_reach``). The
    bounds come from the grouping that makes pairs distinct.
    """
    a, b = prefix.alias("a"), prefix.alias("b")
    met = (a.join(b, F.col("a.tok") == F.col("b.tok"))
           .where(F.col("a.id") < F.col("b.id"))
           .where(F.least("a.n", "b.n") >= min_overlap_size(F.greatest("a.n", "b.n"), t))
           .select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.col("a.n").alias("ni"), F.col("b.n").alias("nj"),
                   F.col("a.pos").alias("pi"), F.col("b.pos").alias("pj")))
    pairs = met.groupBy("i", "j").agg(F.count(F.lit(1)).alias("common"), F.max("pi").alias("pi"), F.max("pj").alias("pj"),
                                      F.max("ni").alias("ni"), F.max("nj").alias("nj"), F.min(F.col("ni") + F.col("nj")).alias("both"))
    most = F.col("common") + F.least(F.col("ni") - F.col("pi"), F.col("nj") - F.col("pj")) - 1
    return (pairs.where(most >= F.ceil(F.lit(t / (1 + t)) * (F.col("ni") + F.col("nj")) - EPS))
            .where(within_reach("common", F.greatest("ni", "nj"), "both", t)).select("i", "j"))


def within_reach(common, larger, both, t: float) -> Column:
    """Whether two sets with so many ``common`` prefix tokens in all can have Jaccard >= t: the size of the larger one, and of both together.

    Of the prefix that ends first in the global order, all tokens that the other set holds are in the other's prefix
    too, and so counted; behind it that set has ``min_overlap_size - 1`` tokens.
    """
    most = F.col(common) + min_overlap_size(larger, t) - 1
    return most >= F.ceil(F.lit(t / (1 + t)) * F.col(both) - EPS)


def token_sketch(docs: DataFrame, tokens: int | None = None) -> np.ndarray:
    """How many sets of ``docs(id, set, n)`` hold tokens of each slot (a token's upper bits), up to 65,535.

    At most ``2 ** SKETCH_BITS`` counters, whatever the input: few tasks count a block of rows each and hand their
    counters on in pieces, which are added up piece by piece. No token is shuffled. ``tokens``: their number, if known.
    """
    from ..session import ship, shuffles_freed
    ship(docs.sparkSession)
    if tokens is None:
        tokens = docs.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    bits = min(SKETCH_BITS, max(SKETCH_PIECE_BITS, int(tokens).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for b in batches:
            np.add.at(counts, token_slots(_elements(b.column(0)), bits), 1)
        counts = np.minimum(counts, 65535).astype(np.uint16)
        for k, piece in enumerate(counts.reshape(-1, 1 << SKETCH_PIECE_BITS)):
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())],
                                                 names=["piece", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                piece = np.frombuffer(zlib.decompress(packed), np.uint16).astype(np.uint32)
                sums[k] = np.minimum(sums[k] + piece, 65535) if k in sums else piece
        for k, piece in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(piece.astype(np.uint16).tobytes(), 1)], pa.binary())],
                                             names=["piece", "counts"])

    few = 2 * docs.sparkSession.sparkContext.defaultParallelism
    parts = docs.select("set").coalesce(few).mapInArrow(count, "piece int, counts binary")
    out = np.zeros((1 << (bits - SKETCH_PIECE_BITS), 1 << SKETCH_PIECE_BITS), np.uint16)
    with shuffles_freed(docs.sparkSession):
        summed = parts.repartition("piece").mapInArrow(total, "piece int, counts binary").collect()
    for r in summed:
        out[r.piece] = np.frombuffer(zlib.decompress(r.counts), np.uint16)
    return out.reshape(-1)


def token_slots(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The counter of each token: the upper bits of its product with an odd constant, so that any keys spread."""
    return ((tokens.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _elements(sets: pa.ListArray) -> np.ndarray:
    """All elements of a column of sets."""
    return np.asarray(sets.flatten())


def sort_rows(flat: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """``flat`` with the values of each row, from its first place to the place after its last, sorted in place."""
    for start, end in bounds:
        flat[start:end].sort()
    return flat


def prefix_arrays(docs: DataFrame, t: float, sketch: np.ndarray, *keep: str) -> DataFrame:
    """(id, n, prefix, *keep) rows of ``docs(id, set, n, *keep)``: each set's prefix in order, found in the row by itself.

    Any global order of the tokens is lossless. Here tokens go by the count of their slot in a bounded sketch, rare
    ones first, then by value: passages that many sets share come last, however many tokens they have.
    """
    bits, sent = len(sketch).bit_length() - 1, docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for b in batches:
            flat, ends = _elements(b.column(1)), np.concatenate([[0], np.cumsum(b.column(2).to_numpy())])
            bounds, lengths = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)), b.column(3).to_numpy()
            flat = sort_rows(flat.copy(), bounds)
            rank = counts[token_slots(flat, bits)]
            tok = [np.zeros(0, np.int64)]
            for (start, end), k in zip(bounds, lengths.tolist(), strict=True):  # by value already: equal ranks keep their order
                tok.append(flat[start:end][np.argsort(rank[start:end], kind="stable")[:k]])
            starts = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.ListArray.from_arrays(starts, pa.array(np.concatenate(tok), pa.int64())),
                                              *b.columns[4:]], names=["id", "n", "prefix", *keep])

    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col("id").cast("long").alias("id"), "set", F.col("n").cast("int").alias("n"),
                       prefix_length(F.col("n"), t).cast("int").alias("k"), *keep).mapInArrow(run, "id long, n int, prefix array<bigint>" + more)


def prefix_table(docs: DataFrame, t: float) -> DataFrame:
    """(id, n, pos, tok) prefix rows of ``docs(id, set, n)``; ``pos`` counts from 0."""
    return prefix_arrays(docs, t, token_sketch(docs)).select("id", "n", F.posexplode("prefix").alias("pos", "tok"))


def verify_pairs(pairs: DataFrame, docs: DataFrame, t: float, a: str = "a", b: str = "b") -> DataFrame:
    """Keep pairs (a, b) whose sets have Jaccard >= t; adds ``sim``."""
    left = docs.select(F.col("id").alias(a), F.col("set").alias("_sa"), F.col("n").alias("_na"))
    right = docs.select(F.col("id").alias(b), F.col("set").alias("_sb"), F.col("n").alias("_nb"))
    ov = F.size(F.array_intersect("_sa", "_sb"))
    return (pairs.join(left, a).join(right, b)
            .withColumn("sim", ov / (F.col("_na") + F.col("_nb") - ov))
            .where(F.col("sim") >= F.lit(t))
            .drop("_sa", "_sb", "_na", "_nb"))


def length_ok(na, nb, t: float):
    return F.least(na, nb) >= min_overlap_size(F.greatest(na, nb), t)
