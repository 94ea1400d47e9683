"""Window sets made from written tokens: the same sets, small tables, only candidates' sets shuffled."""

import glob
import os
import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sievekit.operators import dedup as D
from sievekit.operators import tokensets as TS
from sievekit.operators.simjoin import candidate_pairs, prefix_table
from sievekit.plans import dedup_stage as DS
from helpers import corpus_df


def rows_of(n=60):
    rnd = random.Random(17)
    rows = []
    for i in range(n):
        base = [f"b{i % 7}_{j}" for j in range(40)]
        rows.append((i, base if i % 4 == 0 else [w if rnd.random() > 0.02 else f"x{i}_{j}" for j, w in enumerate(base)]))
    return rows + [(n, ["one", "two"]), (n + 1, [])]


def windows(words, k):
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def test_sets_equal_windows(spark, monkeypatch):
    monkeypatch.setattr(TS, "STRETCH_TOKENS", 100)
    rows = rows_of()
    sets = TS.token_sets(spark.createDataFrame([*rows, (99, None)], "id long, tokens array<string>"), 5)
    got = {r.id: r for r in sets.rows().collect()}
    want = {i: windows(w, 5) for i, w in rows if len(w) >= 5}
    assert {i: len(r.set) for i, r in got.items()} == {i: len(s) for i, s in want.items()} == {i: r.n for i, r in got.items()}
    assert all((set(got[i].set) == set(got[j].set)) == (want[i] == want[j]) == (got[i].key == got[j].key) for i in want for j in want)
    assert all(len(set(got[i].set) & set(got[j].set)) == len(want[i] & want[j]) for i in want for j in want)
    assert {r.id: r.rep for r in sets.members().collect()} == {i: min(j for j in want if want[j] == want[i]) for i in want}
    wanted = {3, 8, 41}
    among = {r.id for r in sets.rows(sets._sent(spark.createDataFrame([(i,) for i in wanted], "id long"))).collect()}
    assert wanted <= among and len(among) < len(want)


def test_pairs_classes_and_rounds(spark):
    """Pairs of representatives as by brute force, whether a component is walked in a task or joined."""
    rows = rows_of()
    c = corpus_df(spark, [(i, [" ".join(w)]) for i, w in rows])
    sets = DS.window_sets(c, 5)
    want = {}
    reps = {r.rep for r in sets.representatives().collect()}
    of = {i: windows(w, 5) for i, w in rows if i in reps}
    for i in of:
        for j in of:
            if i < j and len(of[i] & of[j]) / len(of[i] | of[j]) >= 0.7:
                want[i, j] = len(of[i] & of[j])
    assert want
    for cells in (0, 10 ** 9):
        got = D.component_pairs(*DS.exact_components(sets, 0.7, cells), 0.7).collect()
        assert {(r.i, r.j): r.overlap for r in got} == want and len(got) == len(want)
    assert {(r.i, r.j) for r in DS.exact_pairs(c, 0.7).collect()} == set(want)


def test_repeated_rows(spark):
    """A row that comes twice is one representative, and no duplicate of itself."""
    base = [f"t{i}" for i in range(60)]
    near = [*base[:-1], "other"]
    c = corpus_df(spark, [(5, [" ".join(base)]), (5, [" ".join(base)]), (6, [" ".join(near)]), (6, [" ".join(near)])])
    res = DS.exact_dedup(c, 0.8, 5)
    assert sorted((r[0], r[1]) for r in res.links.collect()) == [(6, 5)]
    assert [r[0] for r in res.kept.collect()] == [5, 5]
    assert [(r.i, r.j) for r in DS.exact_pairs(c, 0.8).collect()] == [(5, 6)]


def test_written_tables_are_small(spark):
    """Long texts of few words that resemble nothing: what is written stays far below the 8 bytes a window of the sets."""
    rng = np.random.RandomState(3)
    rows = [(i, [" ".join(f"w{v}" for v in rng.randint(0, 3000, 2000))]) for i in range(60)]
    base = D.scratch_path(spark, "")
    before = set(glob.glob(os.path.join(base.removeprefix("file:"), "mat-*")))
    res = DS.exact_dedup(corpus_df(spark, rows).repartition(2), 0.8, 5)
    assert res.kept.count() == 60
    new = set(glob.glob(os.path.join(base.removeprefix("file:"), "mat-*"))) - before
    size = sum(os.path.getsize(f) for d in new for f in glob.glob(d + "/*.parquet"))
    assert 0 < size < 60 * 2000 * 8 / 2


class Sent:
    def __init__(self, value):
        self.value = value


def test_packed_rows_open_to_the_same_sets():
    """Two bytes a common token, whatever the others are; the sets are those made from the tokens."""
    rng = np.random.RandomState(5)
    words = rng.randint(-2 ** 62, 2 ** 62, 400)
    lists = [words[rng.randint(0, 400, m)].tolist() for m in (700, 5, 2000, 90, 4)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(lists, pa.list_(pa.int64())), pa.array([9] * 5, pa.int32()), pa.array([b"k"] * 5)],
                                      names=["id", "toks", "n", "key"]).slice(1)
    want = [b.column("set").to_pylist() for b in TS._set_rows(5, None, True)(iter([rows]))]
    for common in (np.sort(words), np.sort(words)[:7], np.zeros(0, np.int64)):
        packed = list(TS._packed_rows(None, Sent(common))(iter([rows])))
        opened = list(TS._opened_rows(5, Sent(common))(iter(packed)))
        assert sum((b.column("set").to_pylist() for b in opened), []) == sum(want, [])
        assert [i for b in opened for i in b.column("id").to_pylist()] == [1, 2, 3, 4] and opened[0].schema.names == ["id", "set", "n", "key"]
        if len(common) == len(words):
            assert sum(len(x) for b in packed for x in b.column("packed").to_pylist()) == sum(4 + 2 * len(x) for x in lists[1:])


def test_id_with_several_texts_keeps_its_representatives(spark):
    """An id that comes with two texts, one of them twice: a set for each text, once."""
    texts = {"a": [f"a{i}" for i in range(50)], "b": [f"b{i}" for i in range(60)]}
    rows = [(5, texts["a"]), (5, texts["b"]), (5, texts["b"]), (7, texts["a"]), (8, ["c"] * 9)]
    sets = TS.token_sets(spark.createDataFrame(rows, "id long, tokens array<string>"), 5)
    docs = sets.of_representatives(spark.createDataFrame([(5,), (7,)], "id long"))
    assert sorted((r.id, r.n, len(set(r.set))) for r in docs.opened(docs.table).collect()) == [(5, 46, 46), (5, 56, 56)]


def test_chance_windows_link_nothing(spark):
    """Sets of 600 whose prefixes share a rare token early are no candidates; those that share 60 are."""
    rows = [(i, 600, pos, -1 if i < 3 and pos == 3 else pos if i > 2 and pos < 60 else 1000 * (i + 1) + pos) for i in range(5) for pos in range(121)]
    pre = spark.createDataFrame(rows, "id long, n int, pos int, tok long")
    assert [(r.i, r.j) for r in candidate_pairs(pre, 0.8).collect()] == [(3, 4)]


def test_bound_keeps_all_similar_pairs(spark):
    """Sets of few tokens and all sizes, whose prefixes overlap by chance: every similar pair is a candidate, also in rounds."""
    rng = random.Random(8)
    base = [rng.sample(range(400), rng.randint(3, 60)) for _ in range(25)]
    docs = {}
    for b in base:
        for _ in range(6):
            docs[len(docs)] = sorted({x if rng.random() > 0.06 else rng.randint(0, 400) for x in b})
    for t in (0.5, 0.8, 0.9):
        want = {(i, j) for i in docs for j in docs if i < j and len({*docs[i]} & {*docs[j]}) / len({*docs[i]} | {*docs[j]}) >= t}
        df = spark.createDataFrame(list(docs.items()), "id long, set array<bigint>")
        cand = {(r.i, r.j) for r in candidate_pairs(prefix_table(df.withColumn("n", F.size("set")), t), t).collect()}
        assert want and want <= cand
        if t != 0.8:
            continue
        kept = []
        for v in sorted(docs):
            if not any((u, v) in want for u in kept):
                kept.append(v)
        state, _ = D.first_wins(df, t, giant_cells=0)
        assert {r.node for r in state.where(F.col("state") == D.KEPT).collect()} == set(kept)


def test_written_tables_leave_no_shuffle_files(spark):
    """A table is read from where it was written; the shuffle that made it goes."""
    dirs = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        return {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}

    before = shuffled()
    table = D._checkpoint(spark.range(20_000).repartition(3, "id").groupBy((F.col("id") % 500).alias("a")).count())
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
    assert table.count() == 500 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
