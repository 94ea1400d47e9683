"""Operator 6: language-model scores by deleted interpolation.

A bigram model: maximum-likelihood estimates of a word after the one before
it, of the word alone, and a uniform share, mixed with weights that depend on
how often the word before was seen (a bucket for each power of two). All of it is
learnt from the training documents: a part of them (one more remainder of the
same hash) is set aside, expectation-maximisation over its tokens finds the
weights, with counts of the other training documents; scores then take those
weights and the counts of all training documents. The documents that must not
be learnt from change neither.

Work is laid out for few and small rows: documents become blocks of word
numbers with the block's sorted word keys; each block asks for the counts of
its distinct words and word pairs (hashed keys) in one sorted list per key
range, and gets its answers in the same order. A key comes once from each
block, however frequent it is, so no key is hot. Among n different words some
two collide with a chance of n**2 / 2**65, among n pairs of n**2 / 2**57; a
collision adds two counts.

Defined cases: a null text is empty and has the end token alone; a null id
counts as the empty string for the split; without documents set aside the
weights stay at their start values; repeated rows are documents of their own;
an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, from_planes, mix64, partitions, planes, read_table, texts_of, tidy, word_keys

#: Remainders of documents that are not learnt from, and of training documents set aside for the weights.
FOLDS, HELD_OUT_FOLD, ASIDE_FOLD = 5, 1, 2
TRAIN, HELD_OUT, ASIDE = 0, 1, 2
ADD = 0.5
#: Tokens of a block, and keys of a range, at which they are closed.
BLOCK_TOKENS, RANGE_KEYS = 500_000, 1_000_000
#: Blocks that a task takes from Spark at once.
BATCH_ROWS = 8
BUCKETS = 66
START_WEIGHTS = (0.4, 0.4, 0.2)
EM_ROUNDS, EM_GAIN = 40, 1e-6
#: Keys of the end token and of the text's start: white space, so that no word has them.
END, START = (xxhash.xxh3_64_intdigest(x) for x in (b"\n", b"\r"))
_PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Pairs are known by 56 bits: a seventh less to move, and a collision only adds two pair counts.
_PAIR_BITS = np.uint64(0xFFFFFFFFFFFFFF00)
WORD, PAIR = 0, 1


def _pairs(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Keys of (word before, word) for all tokens of a block."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = START
    return mix64(before * _PAIR + words) & _PAIR_BITS


@tidy
def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, role, text) to blocks of documents of one role."""
    parts: dict[int, list] = {TRAIN: [], HELD_OUT: [], ASIDE: []}
    sizes = dict.fromkeys(parts, 0)
    number = TaskContext.get().partitionId() << 32

    def block(role: int) -> pa.RecordBatch:
        nonlocal number
        number += 1
        words = np.concatenate([p[1] for p in parts[role]])
        keys, where, count = np.unique(words, return_inverse=True, return_counts=True)
        rank = np.empty(len(keys), np.uint32)  # frequent words get small numbers
        by = np.argsort(-count, kind="stable")
        rank[by] = np.arange(len(keys), dtype=np.uint32)
        out = pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([role], pa.int32()), pa.array([len(words)], pa.int64()),
             pa.array([[p[0] for p in parts[role]]], pa.list_(kind)),
             pa.array([planes(np.array([len(p[1]) for p in parts[role]], np.uint32))], pa.binary()),
             pa.array([planes(np.diff(keys, prepend=np.uint64(0)))], pa.binary()),
             pa.array([planes(by.astype(np.uint32))], pa.binary()), pa.array([planes(rank[where])], pa.binary())],
            names=["block", "role", "n_tokens", "ids", "lengths", "keys", "by_rank", "tokens"])
        parts[role], sizes[role] = [], 0
        return out

    for b in batches:
        kind = b.column(0).type
        for ident, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), strict=True):
            keys = np.append(word_keys(text.translate(LOWER)), np.uint64(END))
            parts[role].append((ident, keys))
            sizes[role] += len(keys)
            if sizes[role] >= BLOCK_TOKENS:
                yield block(role)
    for role in parts:
        if parts[role]:
            yield block(role)


def _unpack(lengths: bytes, keys: bytes, by_rank: bytes, tokens: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, sorted word keys, place of each token's word in them)."""
    return (from_planes(lengths, np.uint32).astype(np.int64), np.cumsum(from_planes(keys, np.uint64), dtype=np.uint64),
            from_planes(by_rank, np.uint32)[from_planes(tokens, np.uint32)])


def _request_rows(ranges: dict[int, int]):
    """Blocks to lists of their distinct keys with training counts, by kind and key range."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                block, role, *packed = (c[k].as_py() for c in b.columns)
                lengths, words, place = _unpack(*packed)
                rows = []
                for kind in (WORD, PAIR):
                    if kind == WORD:
                        keys, count = words, np.bincount(place, minlength=len(words))
                    else:
                        keys, count = np.unique(_pairs(words[place], lengths), return_counts=True)
                    bounds = np.searchsorted(keys, range_starts(ranges[kind]))
                    for r, (a, z) in enumerate(zip(bounds, [*bounds[1:], len(keys)])):
                        if a < z:
                            rows.append((kind, r, block, role, planes(np.diff(keys[a:z], prepend=np.uint64(0))),
                                         None if role == HELD_OUT else planes(count[a:z].astype(np.uint32))))
                for i in range(0, len(rows), 64):
                    part = rows[i:i + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[c] for x in part], t) for c, t in
                         enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                        names=["kind", "range", "block", "role", "keys", "counts"])
    return run


def range_starts(n: int) -> np.ndarray:
    """The least key of each of n equal ranges of 64-bit keys."""
    return np.array([(i << 64) // n for i in range(n)], np.uint64)


@tidy
def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (kind, range): the training counts of each block's keys; a row of totals for each range (block null).

    Blocks set aside get the counts without their part (``rest``) too, and so do the totals.
    """
    group, held = None, []

    def answers() -> pa.RecordBatch:
        keys = np.concatenate([x[2] for x in held])
        counts = np.concatenate([x[3] for x in held])
        aside = np.repeat([x[1] == ASIDE for x in held], [len(x[2]) for x in held])
        _, where = np.unique(keys, return_inverse=True)
        n = int(where.max()) + 1
        total = np.bincount(where, counts, minlength=n).astype(np.uint64)
        rest = np.bincount(where[~aside], counts[~aside], minlength=n).astype(np.uint64)
        rows, at = [], 0
        for block, role, own, _ in held:
            mine = where[at:at + len(own)]
            rows.append((block, planes(total[mine]), planes(rest[mine]) if role == ASIDE else None, None, None, None, None))
            at += len(own)
        rows.append((None, None, None, *(int(f(x)) for x in (total, rest) for f in (np.count_nonzero, np.sum))))
        kind, r = group
        types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(rows), pa.int32()), pa.array([r] * len(rows), pa.int32()),
             *(pa.array([x[c] for x in rows], t) for c, t in enumerate(types))],
            names=["kind", "range", "block", "answer", "rest", "n_distinct", "n_total", "rest_distinct", "rest_total"])

    for b in batches:
        for kind, r, block, role, keys, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (kind, r) != group:
                if held:
                    yield answers()
                group, held = (kind, r), []
            own = np.cumsum(from_planes(keys, np.uint64), dtype=np.uint64)
            held.append((block, role, own, from_planes(counts, np.uint32) if counts is not None else np.zeros(len(own), np.uint32)))
    if held:
        yield answers()


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + the power of two below its count."""
    return np.where(context > 0, 1 + np.frexp(np.maximum(context, 1).astype(float))[1] - 1, 0)


def estimates(context: np.ndarray, pair: np.ndarray, word: np.ndarray, tokens: int, types: int) -> np.ndarray:
    """The three estimates of each token, in the order of START_WEIGHTS."""
    return np.stack([pair / np.maximum(context, 1), word / max(tokens, 1), np.full(len(word), 1 / (types + 1))])


def _answered(judge, schema: pa.Schema, train_documents: int):
    """Rows sorted by (block, answers before the block, kind, range): ``judge`` gets each block with its counts."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, got = None, {WORD: [], PAIR: []}
        for b in batches:
            for k in range(b.num_rows):
                number, kind, answer, role, ids, *packed = (b.column(c)[k] for c in (0, 1, 3, 4, 5, 6, 7, 8, 9))
                number = number.as_py()
                if number != block:
                    block, got = number, {WORD: [], PAIR: []}
                if answer.is_valid:
                    got[kind.as_py()].append(from_planes(answer.as_py(), np.uint64))
                    continue
                lengths, words, place = _unpack(*(x.as_py() for x in packed))
                word = np.concatenate(got[WORD])[place].astype(np.int64)
                _, where = np.unique(_pairs(words[place], lengths), return_inverse=True)
                pair = np.concatenate(got[PAIR])[where].astype(np.int64)
                context = np.empty_like(word)
                context[1:] = word[:-1]  # the end token never is a context, so a word's count is its count as one
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                context[starts] = train_documents
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, f.type) for x, f in zip(judge(role.as_py(), ids.values, lengths, starts, context, pair, word),
                                                         schema, strict=True)], schema=schema)
                block = None
    return run


def _distinct_counts(role, ids, lengths, starts, context, pair, word):
    """The distinct (context, pair, word) counts of a block, each with its number of tokens."""
    rows = np.column_stack([context, pair, word])
    by = np.lexsort(rows.T)
    rows = rows[by]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]))
    n = np.diff(np.append(first, len(rows)))
    return [[planes(np.ascontiguousarray(c))] for c in (*rows[first].T, n.astype(np.int64))]


def _expected(weights: np.ndarray, tokens: int, types: int):
    """One step of expectation: expected tokens of each estimate and the log likelihood, by bucket."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, 4))
        for b in batches:
            for k in range(b.num_rows):
                context, pair, word, n = (from_planes(c[k].as_py(), np.int64) for c in b.columns)
                bucket = bucket_of(context)
                part = weights[bucket].T * estimates(context, pair, word, tokens, types)
                p = part.sum(0)
                for e in range(3):
                    total[:, e] += np.bincount(bucket, n * part[e] / p, BUCKETS)
                total[:, 3] += np.bincount(bucket, n * np.log(p), BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS), pa.int32()), *(pa.array(c) for c in total.T)],
                                         names=["bucket", "e0", "e1", "e2", "likelihood"])
    return run


def learn_weights(aside: DataFrame, tokens: int, types: int) -> np.ndarray:
    """Mixture weights by bucket; the driver gets BUCKETS rows of sums a round. One expected token is added to each."""
    weights, last = np.tile(START_WEIGHTS, (BUCKETS, 1)), -math.inf
    for _ in range(EM_ROUNDS):
        sums = (aside.mapInArrow(_expected(weights, tokens, types), "bucket int, e0 double, e1 double, e2 double, likelihood double")
                .groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("e0", "e1", "e2", "likelihood"))).collect())
        expected = np.zeros((BUCKETS, 3))
        for r in sums:
            expected[r.bucket] = r.e0, r.e1, r.e2
        likelihood = sum(r.likelihood for r in sums)
        if not expected.any() or likelihood - last <= EM_GAIN * abs(likelihood):
            break
        last = likelihood
        weights = (expected + np.array(START_WEIGHTS)) / (expected.sum(1, keepdims=True) + sum(START_WEIGHTS))
    return weights


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS,
                held_out_fold: int = HELD_OUT_FOLD, aside_fold: int = ASIDE_FOLD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    scratch, n = Scratch(spark, "lm"), partitions(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds
    role = F.when(fold == held_out_fold, HELD_OUT).when(fold == aside_fold, ASIDE).otherwise(TRAIN)
    split = docs.select(F.col(id_col).alias("doc_id"), role.alias("role"), F.col(text_col))
    blocks = scratch.write(split.mapInArrow(
        _block_rows, f"block long, role int, n_tokens long, ids array<{kind}>, lengths binary, keys binary, "
                     f"by_rank binary, tokens binary"), "blocks")
    size = blocks.agg(F.sum("n_tokens").alias("tokens"), F.sum(F.length("keys") / 8).alias("words"),
                      *(F.sum(F.when(of, F.size("ids"))).alias(c) for c, of in
                        (("documents", F.col("role") != HELD_OUT), ("rest", F.col("role") == TRAIN)))).first()
    ranges = {WORD: max(1, int((size.words or 0) / RANGE_KEYS)), PAIR: max(1, int((size.tokens or 0) / RANGE_KEYS))}
    counts = scratch.write(
        blocks.select("block", "role", "lengths", "keys", "by_rank", "tokens")
        .mapInArrow(_request_rows(ranges), "kind int, range int, block long, role int, keys binary, counts binary")
        .repartition(n, "kind", "range").sortWithinPartitions("kind", "range", "block")
        .mapInArrow(_count_rows, "kind int, range int, block long, answer binary, rest binary, n_distinct long, n_total long, "
                                 "rest_distinct long, rest_total long"), "counts", BATCH_ROWS)
    totals = counts.where(f"block is null and kind = {WORD}").agg(
        *(F.sum(c).alias(c) for c in ("n_distinct", "n_total", "rest_distinct", "rest_total"))).first()
    types, tokens, rest_types, rest_tokens = (x or 0 for x in totals)
    documents, rest_documents = size.documents or 0, size.rest or 0
    columns = ["block", "kind", "range", "answer", "role", "ids", "lengths", "keys", "by_rank", "tokens"]
    answers = counts.where("block is not null").select("block", "kind", "range", "answer", "rest")

    def with_answers(some: DataFrame, of: DataFrame) -> DataFrame:
        return (of.unionByName(some.drop("n_tokens"), allowMissingColumns=True).select(*columns)
                .repartition(n, "block").sortWithinPartitions("block", F.col("answer").isNull(), "kind", "range"))

    blocks_aside = blocks.where(F.col("role") == ASIDE)
    binary = pa.schema([(c, pa.binary()) for c in ("context", "pair", "word", "n")])
    aside = scratch.write(
        with_answers(blocks_aside, answers.where("rest is not null").select("block", "kind", "range", F.col("rest").alias("answer")))
        .mapInArrow(_answered(_distinct_counts, binary, rest_documents), "context binary, pair binary, word binary, n binary"), "aside", BATCH_ROWS)
    weights = learn_weights(aside, rest_tokens, rest_types)
    base = math.log10(tokens + ADD * (types + 1)) if types else 0.0

    def scores(role, ids, lengths, starts, context, pair, word):
        p = (weights[bucket_of(context)].T * estimates(context, pair, word, tokens, types)).sum(0)
        return (ids, np.full(len(lengths), role == HELD_OUT), lengths, np.add.reduceat((word > 0).astype(np.int64), starts),
                np.full(len(lengths), tokens), np.add.reduceat(np.log10(word + ADD) - base, starts),
                np.add.reduceat(np.log10(p), starts))

    id_type = blocks.schema["ids"].dataType.elementType
    from pyspark.sql.pandas.types import to_arrow_type
    out = pa.schema([("doc_id", to_arrow_type(id_type)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    scored = scratch.write(with_answers(blocks, answers.drop("rest")).mapInArrow(
        _answered(scores, out, documents),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"),
        "scores", BATCH_ROWS)
    scratch.drop("blocks", "counts", "aside")
    return scored


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def brute_force(documents: list[tuple[int, str]]) -> list[tuple]:
    """The query's rows by plain dictionaries, for tests."""
    texts = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % FOLDS,
              [*(t or "").encode().translate(LOWER).split(), b"\n"]) for i, t in documents]

    def model(of: list[list[bytes]]):
        word, pair = Counter(), Counter()
        for w in of:
            word.update(w)
            pair.update(zip([b"\r", *w], w))
        before = word | Counter({b"\r": len(of)})
        tokens, types = sum(word.values()), len(word)
        return word, tokens, types, before, lambda h, w: (pair[h, w] / max(before[h], 1), word[w] / max(tokens, 1), 1 / (types + 1))

    bucket = lambda c: c.bit_length()
    *_, before, probs = model([w for _, fold, w in texts if fold not in (HELD_OUT_FOLD, ASIDE_FOLD)])
    weights, last = {b: START_WEIGHTS for b in range(BUCKETS)}, -math.inf
    for _ in range(EM_ROUNDS):
        expected, likelihood = {}, 0.0
        for _, fold, w in texts:
            for a, b in zip([b"\r", *w], w) if fold == ASIDE_FOLD else ():
                k = bucket(before[a])
                part = [x * y for x, y in zip(weights[k], probs(a, b))]
                likelihood += math.log(sum(part))
                e = expected.setdefault(k, [0.0] * 3)
                for j in range(3):
                    e[j] += part[j] / sum(part)
        if not expected or likelihood - last <= EM_GAIN * abs(likelihood):
            break
        last = likelihood
        weights = {b: [(x + s) / (sum(expected.get(b, [0] * 3)) + sum(START_WEIGHTS)) for x, s in
                       zip(expected.get(b, [0.0] * 3), START_WEIGHTS)] for b in range(BUCKETS)}
    word, tokens, types, before, probs = model([w for _, fold, w in texts if fold != HELD_OUT_FOLD])
    out = []
    for i, fold, w in texts:
        score = sum(math.log10(sum(x * y for x, y in zip(weights[bucket(before[a])], probs(a, b))))
                    for a, b in zip([b"\r", *w], w))
        base = sum(math.log10((word[x] + ADD) / (tokens + ADD * (types + 1))) for x in w)
        out.append((i, fold == HELD_OUT_FOLD, len(w), sum(word[x] > 0 for x in w), tokens, base, score))
    return out
