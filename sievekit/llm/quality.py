"""Operator 3: quality rules judged by an isolation forest over rule statistics.

Every text gives a row of rule statistics. Random axis-parallel splits of
small samples isolate unusual rows after few splits; the mean path length over
the trees gives an anomaly score, and the cut-off is set from labelled rows.

Defined cases: a null or empty text has no words and fails the base rules;
labels with a null id or quality are ignored, several labels of one document
count as the worst of them; without labels of both kinds only the base rules
decide; repeated rows are judged alike, each; an empty table gives an empty
result; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, read_table, slices, texts_of, tidy

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
TREES, TREE_ROWS = 100, 256
#: Largest sample of labelled rows that trees are grown from.
FIT_ROWS = TREES * TREE_ROWS
SCORE_BINS = 2000
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MORE = "n_lines long, n_distinct_words long, n_letters long, n_upper long, n_digits long, max_word long"
_KIND = np.zeros(256, np.uint8)  # of a byte: 1 space, 2 symbol, 4 letter or part of one, 8 upper case, 16 digit, 32 continuation
_KIND[list(SPACES)] = 1
_KIND[list(SYMBOLS)] = 2
_KIND[[*range(65, 91)]] = 12
_KIND[[*range(97, 123), *range(192, 256)]] = 4
_KIND[48:58] = 16
_KIND[128:192] = 32


def text_stats(text: bytes) -> tuple[int, ...]:
    """The columns of STATS and MORE for one text in UTF-8."""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * 11
    kind = _KIND[np.frombuffer(text, np.uint8)]
    spaces = np.count_nonzero(kind & 1)
    points = len(text) - np.count_nonzero(kind & 32)
    symbols, letters = np.count_nonzero(kind & 2), np.count_nonzero(kind & 4)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeated = 0
    if n > 3 and len(number) < n:
        # windows as numbers below distinct**2 * distinct, ranked after two words so that they fit 64 bits
        pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        _, which, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        hit = count[which] > 1
        inside = np.zeros(n, bool)
        for k in range(3):
            inside[k:n - 2 + k] |= hit
        repeated = int(inside.sum())
    return (n, points - spaces, symbols, len(lines) - len(set(lines)), repeated, len(lines), len(number), letters,
            np.count_nonzero(kind & 8), np.count_nonzero(kind & 16), max(map(len, words)))


def _names(*schemas: str) -> list[str]:
    return [x.split()[0] for schema in schemas for x in schema.split(", ")]


def rule_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, STATS, MORE) of every row; ``carry`` adds the input row as the struct column ``row``."""
    names = _names(STATS, MORE)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = np.array([text_stats(t) for t in texts_of(b.column(1))], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in rows.T), *b.columns[2:]],
                                             names=["doc_id", *names, *["row"] * carry])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.struct(*docs.columns).alias("row")] * carry)
    schema = T.StructType([picked.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in names),
                           *[T.StructField("row", docs.schema)] * carry])
    return picked.mapInArrow(run, schema)


def features(s: pd.DataFrame) -> np.ndarray:
    """What the forest splits on: ratios that do not grow with the text; shares that are mostly 0 on a log scale."""
    n = np.maximum(s.n_words.to_numpy(float), 1)
    chars = np.maximum(s.word_chars.to_numpy(float), 1)
    lines = np.maximum(s.n_lines.to_numpy(float), 1)
    share = lambda x, of: np.log(x.to_numpy(float) / of + 1e-3)
    return np.column_stack([
        np.log(chars / n), share(s.n_symbols, chars), share(s.n_dup_lines, lines), share(s.n_repeat_words, n),
        s.n_letters / chars, share(s.n_upper, chars), share(s.n_digits, chars)])


#: Bounds that splits of each feature are drawn from at the root; fixed, as rows beyond the grown sample must be isolated too.
DOMAIN = np.array([[0.0, 4.0], [np.log(1e-3), 0.0], [np.log(1e-3), 0.0], [np.log(1e-3), 0.0], [0.0, 1.0],
                   [np.log(1e-3), 0.0], [np.log(1e-3), 0.0]])


class IsolationForest:
    """Trees as arrays, so that a batch of rows walks all of them level by level."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 0):
        rng = np.random.default_rng(seed)
        rows = min(rows, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(rows, 2)))))
        self.norm = self._mean_path(rows) or 1.0
        self.trees = [self._grow(x[rng.choice(len(x), rows, replace=False)], rng) for _ in range(trees)]

    @staticmethod
    def _mean_path(n: float) -> float:
        """Mean depth of an unsuccessful search in a binary tree of n rows."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, x: np.ndarray, rng):
        """One tree. Splits are drawn from the node's box, not from its rows' range: empty branches end early and
        so mark values that the sample never shows."""
        n = 2 ** (self.depth + 1)
        feature, split, path = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n)
        todo = [(1, x, 0, DOMAIN)]
        while todo:
            node, part, level, box = todo.pop()
            if len(part) <= 1 or level == self.depth:  # a leaf: it stays where it is on the levels below
                below = [node]
                while below:
                    k = below.pop()
                    path[k] = level + self._mean_path(len(part))
                    if 2 * k < n:
                        below += [2 * k, 2 * k + 1]
                continue
            f = rng.integers(x.shape[1])
            at = rng.uniform(*box[f])
            feature[node], split[node] = f, at
            left = part[:, f] <= at
            for side, rows in ((0, left), (1, ~left)):
                half = box.copy()
                half[f, 1 - side] = at
                todo.append((2 * node + side, part[rows], level + 1, half))
        return feature, split, path

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): 2 ** -(mean path / expected path)."""
        total, row = np.zeros(len(x)), np.arange(len(x))
        for feature, split, path in self.trees:
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (x[row, feature[node]] > split[node])
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_id: str = "doc_id", quality_col: str = "quality", fit_rows: int = FIT_ROWS, carry: bool = False) -> DataFrame:
    """Statistics and verdict of every document: doc_id, STATS, base_failed, score, kept (and row, if carried).

    The trees are grown from at most ``fit_rows`` documents labelled good that
    pass the base rules. The cut-off makes the share of bad documents caught
    less the share of good ones lost largest, over all labelled documents that
    pass the base rules; of equal cut-offs the one that keeps most.
    """
    spark = docs.sparkSession
    stats = Scratch(spark, "quality").write(rule_stats(docs, id_col, text_col, carry), "stats")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    stats = stats.withColumn("base_failed", failed)
    marks = (labels.where(F.col(label_id).isNotNull() & F.col(quality_col).isNotNull())
             .groupBy(F.col(label_id).alias("doc_id")).agg(F.min(quality_col).alias("_good")))
    names, out = _names(STATS, MORE), ["doc_id", *_names(STATS), "base_failed"]
    marked = stats.where("not base_failed").select("doc_id", *names).join(marks, "doc_id")
    sample = (marked.where("_good = 1").orderBy(F.md5(F.col("doc_id").cast("string")), *names)
              .limit(fit_rows).toPandas())
    if len(sample) < 2:
        return stats.select(*out, F.lit(None).cast("double").alias("score"), (~F.col("base_failed")).alias("kept"), *["row"] * carry)
    forest = IsolationForest(features(sample))

    @F.pandas_udf("double")
    def score(s: pd.DataFrame) -> pd.Series:
        return pd.Series(forest.score(features(s)) if len(s) else [], dtype=float)

    score_of = score(F.struct(*names))
    bins = (marked.groupBy(F.floor(score_of * SCORE_BINS).cast("int").alias("bin"))
            .agg(F.count(F.when(F.col("_good") > 0, 1)).alias("good"), F.count(F.when(F.col("_good") <= 0, 1)).alias("bad"))
            .orderBy(F.desc("bin")).collect())  # at most SCORE_BINS rows
    goods, bads = max(1, sum(b.good for b in bins)), max(1, sum(b.bad for b in bins))
    lost = caught = 0
    best, cut = 0.0, 1.0
    for b in bins:
        lost, caught = lost + b.good, caught + b.bad
        if caught / bads - lost / goods > best:
            best, cut = caught / bads - lost / goods, b.bin / SCORE_BINS
    verdict = ~F.col("base_failed") & (F.col("score") < cut)
    return stats.withColumn("score", score_of).select(*out, "score", verdict.alias("kept"), *["row"] * carry)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return judge_quality(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "labels"))
