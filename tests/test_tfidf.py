"""Row-local term counts and weights."""

import math
from collections import Counter

from pyspark.sql import functions as F

from sievekit.operators import tfidf as TF


def test_term_counts_equal_counter(spark):
    rows = [(0, ["b", "a", "b"]), (1, []), (2, ["é", "z", "é", "é"]), (3, ["x"])]
    df = spark.createDataFrame(rows, "design_idx int, t array<string>")
    got = {r.design_idx: {x.term: x.tf for x in r.c} for r in df.select("design_idx", TF.term_counts(F.col("t")).alias("c")).collect()}
    assert got == {i: dict(Counter(t)) for i, t in rows}


def test_weights_are_normalised_and_empty_vocabulary_gives_none(spark):
    rows = [(i, ["a", "a", "b"] if i % 2 else ["b", "c"]) for i in range(10)]
    df = spark.createDataFrame(rows, "design_idx int, tokens array<string>")
    m = TF.fit_transform(df, max_df=1.0, n_max=1)
    norm = {}
    for r in m.weights.collect():
        norm[r.design_idx] = norm.get(r.design_idx, 0) + r.weight ** 2
    assert len(norm) == 10 and all(math.isclose(x, 1) for x in norm.values())
    none = TF.fit_transform(df, min_df=100)
    assert none.vocabulary.count() == 0 and none.weights.count() == 0


def test_vocabulary_equals_counts_of_all_ngrams(spark):
    """Terms of words too rare for the vocabulary are never counted; few or no eligible words prune nothing."""
    import random
    from collections import Counter
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, rnd.choices(words, [1 / (j + 1) for j in range(60)], k=rnd.randint(0, 60))) for i in range(80)]
    rows += [(100, []), (101, ["Same", "same"]), (102, ["same", "SAME", "w1"])]
    tf, df = Counter(), Counter()
    for _, t in rows:
        t = [x.lower() for x in t]
        grams = [" ".join(t[i:i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)]
        tf.update(grams)
        df.update(set(grams))
    docs = spark.createDataFrame(rows, "design_idx long, tokens array<string>")
    for size in (12, 60, 100000):
        want = sorted((g for g in tf if 2 <= df[g] <= 0.95 * len(rows)), key=lambda g: (-tf[g], g))[:size]
        got = {r.term: (r.df, r.sum_tf) for r in TF.fit_transform(docs, max_features=min(size, 500)).vocabulary.collect()}
        assert got == {g: (df[g], tf[g]) for g in want[:500]}
    strong = TF.strong_words(TF.gram_stats(docs, 1, 1), 12, 2, 0.95 * len(rows))
    assert 12 <= len(strong) < 20
    assert {r.term for r in TF.gram_stats(docs, 2, 3, strong).collect()} < set(tf)
