"""A group of copies holding a third of all rows: collapsed before the pair join,
result equal to a brute-force greedy walk over exact Jaccard."""

from pyspark.sql import functions as F

from sievekit.operators.simjoin import collapse_equal_sets, jaccard_self_join
from sievekit.plans import dedup_stage as DS
from helpers import corpus_df


def _shingles(text, k=5):
    t = text.split()
    return {" ".join(t[i:i + k]) for i in range(len(t) - k + 1)}


def test_hot_copy_group(spark):
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(45):
        if i % 3 == 0:
            words = base                                  # 15 byte-equal copies
        elif i % 3 == 1:
            words = base[:70] + [f"x{i}_{j}" for j in range(10)]  # near copies
        else:
            words = [f"r{i}_{j}" for j in range(60)]      # unrelated
        rows.append((i, [" ".join(words)]))
    c = corpus_df(spark, rows)
    sets = DS.hashed_shingle_sets(c, 5)
    reps, members = collapse_equal_sets(sets.where(F.size("set") > 0))
    assert reps.count() == 31                              # 15 copies -> 1 representative
    pairs = jaccard_self_join(reps, 0.8).collect()
    assert all(p["i"] != p["j"] for p in pairs)
    res = DS.exact_dedup(c, 0.8, 5)
    # brute force
    sh = {i: _shingles(t[0]) for i, t in rows}
    kept = []
    for v in sorted(sh):
        if not any(len(sh[v] & sh[u]) / len(sh[v] | sh[u]) >= 0.8 for u in kept):
            kept.append(v)
    assert {r[0] for r in res.kept.collect()} == set(kept)
