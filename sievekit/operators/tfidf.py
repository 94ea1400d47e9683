"""TF-IDF over word 1..3-grams in long form ``(design_idx, term, weight)``.

Semantics of the fitted vectorizer: lower-cased tokens, n-grams 1..3,
vocabulary = terms with df >= min_df and df <= max_df * n, then the
``max_features`` terms of highest corpus frequency (ties: term ascending),
sublinear tf ``1 + ln tf``, smooth idf ``ln((1+n)/(1+df)) + 1``, row L2 norm.

Plan: tokens (written once) -> statistics of words -> statistics of the n-grams made of words
frequent enough for the vocabulary (both counted by an Arrow kernel, partial sums per term shuffled) -> top-``max_features`` (TakeOrderedAndProject,
bounded) -> weights and norm in the row, from the bounded vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shingles import let
from ..session import ship

#: Tokens that the counting kernel takes at once (one longer document goes by itself); words that may be sent to it.
STRETCH_TOKENS, STRONG_WORDS = 1 << 20, 10_000


def word_ngrams(tokens: Column, n_min: int = 1, n_max: int = 3) -> Column:
    """All word n-grams, n_min..n_max, joined by a space (with repeats)."""
    def grams(t: Column) -> Column:
        parts = [F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(0))),
                             _joiner(t, n)) for n in range(n_min, n_max + 1)]
        # sequence(1, 0) yields [1, 0]; keep only real start positions
        parts = [F.filter(p, lambda g: g.isNotNull()) for p in parts]
        return F.flatten(F.array(*parts))
    return let(tokens, grams)


def _joiner(t: Column, n: int):
    return lambda i: F.when(i >= 1, F.when(i + n - 1 <= F.size(t), F.array_join(F.slice(t, i, n), " ")))


@dataclass
class TfidfModel:
    vocabulary: DataFrame   # (term, dim, df, sum_tf, idf) - at most max_features rows
    weights: DataFrame      # (design_idx, term, dim, weight) non-zero entries
    n_docs: int


def fit_transform(docs: DataFrame, tokens_col: str = "tokens", max_features: int = 200,
                  min_df: int = 2, max_df: float = 0.95, n_min: int = 1, n_max: int = 3) -> TfidfModel:
    """``docs(design_idx, tokens array<string>)`` -> vocabulary and L2-normalised weights."""
    from ..operators.dedup import _checkpoint
    lowered = _checkpoint(docs.select("design_idx", F.transform(F.col(tokens_col), F.lower).alias("tokens")))
    n_docs = lowered.count()
    most_df = max_df * n_docs
    words = _checkpoint(gram_stats(lowered, 1, 1))
    stats = words if n_min == 1 else words.limit(0)
    if n_max > 1:
        stats = stats.unionByName(gram_stats(lowered, max(2, n_min), n_max, strong_words(words, max_features if n_min == 1 else None, min_df, most_df)))
    eligible = stats.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(most_df)))
    top = eligible.orderBy(F.desc("sum_tf"), "term").limit(max_features)
    vocab = _checkpoint(top.withColumn(
        "idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0))
    # dimension = alphabetical rank inside the (bounded) vocabulary
    vocab = vocab.withColumn("dim", F.row_number().over(Window.orderBy("term")) - 1)
    rows = vocab.select("term", "dim", "idf").collect()  # at most max_features
    grams = F.filter(word_ngrams(F.col("tokens"), n_min, n_max), lambda g: g.isin([r["term"] for r in rows]) if rows else F.lit(False))
    weights = lowered.select("design_idx", F.explode(row_weights(term_counts(grams), rows)).alias("w")).select(
        "design_idx", "w.term", "w.dim", "w.weight")
    return TfidfModel(vocab.select("term", "dim", "df", "sum_tf", "idf"), weights, n_docs)


def strong_words(words: DataFrame, max_features: int | None, min_df: int, most_df: float) -> list[str] | None:
    """The words that the terms of a vocabulary can be made of, a bounded list; None if any can.

    A term occurs at most as often as each of its words, and in at most as many documents. So once ``max_features``
    eligible words occur ``least`` times, no term with a rarer word is among the ``max_features`` most frequent.
    """
    if max_features is None:
        return None
    top = (words.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(most_df))).orderBy(F.desc("sum_tf")).limit(max_features)
           .agg(F.count(F.lit(1)).alias("n"), F.min("sum_tf").alias("least")).first())
    least = top.least if top.n == max_features else 0
    found = words.where((F.col("df") >= min_df) & (F.col("sum_tf") >= least)).select("term").limit(STRONG_WORDS + 1).collect()
    return [r.term for r in found] if len(found) <= STRONG_WORDS else None


def gram_stats(docs: DataFrame, n_min: int, n_max: int, words: list[str] | None = None) -> DataFrame:
    """(term, df, sum_tf) of the n-grams of ``docs(tokens)``; with ``words`` only of n-grams that are made of these.

    An Arrow kernel counts them in stretches of documents, whose counts are summed. Tokens hold no blanks.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if words is None else pa.array(words, pa.string())
        for b in batches:
            column, start = b.column(0), 0
            ends = np.cumsum(np.asarray(pc.list_value_length(column).fill_null(0)).astype(np.int64))
            while start < len(column):
                done = ends[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(ends, done + STRETCH_TOKENS, "right")))
                yield from stretch_counts(column.slice(start, end - start).flatten(), ends[start:end] - done, n_min, n_max, known)
                start = end

    parts = docs.select("tokens").mapInArrow(run, "term string, df long, sum_tf long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("sum_tf").alias("sum_tf"))


def stretch_counts(tokens: pa.Array, ends: np.ndarray, n_min: int, n_max: int, known: pa.Array | None) -> Iterator[pa.RecordBatch]:
    """Counts (term, df, sum_tf) over documents whose tokens end at ``ends``; tokens that are not ``known`` are in no term."""
    if known is None:
        packed = tokens.dictionary_encode()
        codes, known = np.asarray(packed.indices).astype(np.int64), packed.dictionary
    else:
        codes = np.asarray(pc.index_in(tokens, value_set=known).fill_null(-1)).astype(np.int64)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    at = np.flatnonzero(codes >= 0)  # where a term of n words begins
    key = codes[at]
    for n in range(1, n_max + 1):
        if n > 1:  # one more word each: of the same document, and known
            last = at + n - 1
            fits = last < len(codes)
            fits[fits] = (doc[last[fits]] == doc[at[fits]]) & (codes[last[fits]] >= 0)
            at, key = at[fits], key[fits] * len(known) + codes[last[fits]]
        if not len(at):
            return
        _, first, key = np.unique(key, return_index=True, return_inverse=True)  # dense, so that one more word fits
        begin = at[first]
        if n >= n_min:
            held = np.unique(key + doc[at] * len(first)) % len(first)
            parts = [known.take(pa.array(codes[begin + j])) for j in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pc.binary_join_element_wise(*parts, " ").cast(pa.string()), pa.array(np.bincount(held, minlength=len(first)), pa.int64()),
                 pa.array(np.bincount(key, minlength=len(first)), pa.int64())], names=["term", "df", "sum_tf"])


def term_counts(terms: Column) -> Column:
    """``array<struct<term, tf>>`` of an array of terms with repeats: runs of the sorted array, found in the row."""
    def runs(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))),
                          lambda i: F.when(F.size(t) == 0, F.lit(False)).when(i == 1, F.lit(True))
                          .otherwise(F.get(t, i - 1) != F.get(t, i - 2)))
        return let(starts, lambda s: F.transform(s, lambda i, k: F.struct(
            F.get(t, i - 1).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(t) + 1) - i).cast("bigint").alias("tf"))))
    return let(F.array_sort(terms), runs)


def row_weights(terms: Column, vocab: list) -> Column:
    """``array<struct<term, dim, weight>>`` of a row's counted terms that are in the bounded vocabulary, L2-normalised."""
    if not vocab:
        return F.array().cast("array<struct<term:string,dim:int,weight:double>>")
    known = [r["term"] for r in vocab]
    table = F.create_map(*[x for r in vocab for x in (
        F.lit(r["term"]), F.struct(F.lit(int(r["dim"])).alias("dim"), F.lit(float(r["idf"])).alias("idf")))])

    def weigh(found: Column) -> Column:
        raw = F.transform(found, lambda t: F.struct(
            t["term"].alias("term"), table[t["term"]]["dim"].alias("dim"), ((1.0 + F.log(t["tf"])) * table[t["term"]]["idf"]).alias("raw")))
        return let(raw, lambda ws: let(F.sqrt(F.aggregate(ws, F.lit(0.0), lambda a, w: a + w["raw"] * w["raw"])),
                                       lambda n: F.transform(ws, lambda w: F.struct(
                                           w["term"].alias("term"), w["dim"].alias("dim"), (w["raw"] / n).alias("weight")))))
    return let(F.filter(terms, lambda t: t["term"].isin(known)), weigh)


def sparsity(weights: DataFrame, n_docs: int, n_cols: int) -> DataFrame:
    """1 - nnz / (rows * cols) of the weight matrix."""
    return weights.agg(F.count(F.lit(1)).alias("nnz")).select(
        F.lit(n_docs).cast("bigint").alias("n_rows"), F.lit(n_cols).cast("bigint").alias("n_cols"),
        F.col("nnz"),
        F.when(F.lit(n_docs * n_cols) > 0, 1 - F.col("nnz") / F.lit(float(max(n_docs * n_cols, 1))))
        .alias("sparsity"))
