"""MinHash parameters, lossless pigeonhole bands, signature estimates."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sievekit.operators import minhash as MH


def test_optimal_bands_match_published_choice():
    assert MH.optimal_bands(0.8, 128) == (9, 13)
    assert MH.optimal_bands(0.85, 128) == (8, 16)


def test_pigeonhole_bands_cover_and_are_lossless():
    for t in (0.5, 0.8, 0.85, 0.95):
        bands = MH.pigeonhole_bands(t, 128)
        assert sum(n for _, n in bands) == 128
        need = math.ceil(t * 128 - 1e-9)
        rnd = random.Random(1)
        for _ in range(200):
            bad = set(rnd.sample(range(1, 129), 128 - need))
            assert any(all(p not in bad for p in range(s, s + n)) for s, n in bands)


def test_signature_estimate_close_to_jaccard(spark):
    a = [f"s{i}" for i in range(400)]
    b = a[:300] + [f"x{i}" for i in range(100)]
    h = spark.createDataFrame([(0, a), (1, b), (2, [])], "id long, s array<string>").select("id", MH.shingle_hashes31(F.col("s")).alias("hashes"))
    sig = {r.id: r.sig for r in MH.signatures(h).collect()}
    hashes = {r.id: r.hashes for r in h.collect()}
    pa_, pb_ = MH.permutations()
    assert all(sig[i] == [min((x * v + y) % MH.MERSENNE_P for v in hashes[i]) for x, y in zip(pa_, pb_)] for i in (0, 1))
    assert sig[2] is None
    row = spark.createDataFrame([(sig[0], sig[1])], "sa array<bigint>, sb array<bigint>").select(MH.matches(F.col("sa"), F.col("sb")).alias("m")).first()
    m = row["m"]
    assert m == sum(p == q for p, q in zip(sig[0], sig[1]))
    j = 300 / 500
    sigma = math.sqrt(j * (1 - j) / 128)
    assert abs(m / 128 - j) < 4 * sigma


def test_kernel_at_the_edges_and_over_stretches():
    a, b = (np.array(x, np.uint64) for x in MH.permutations())
    for hashes in ([0, 1, MH.MERSENNE_P - 1], [MH.MERSENNE_P - 1], list(range(7, 9_000_007, 6011))):
        got = MH.signature_values(np.array(hashes, np.uint64), a, b)
        assert got.tolist() == [min((int(x) * h + int(y)) % MH.MERSENNE_P for h in hashes) for x, y in zip(a, b)]


def test_self_join_equals_brute_force(spark):
    rng = np.random.RandomState(2)
    base = rng.randint(0, 1000, (4, 128))
    rows = [(i, [int(v) if rng.rand() > 0.12 else int(rng.randint(0, 1000)) for v in base[i % 4]]) for i in range(24)] + [(50, None), (51, list(range(128)))]
    got = {(r.i, r.j): r.similarity for r in MH.signature_self_join(spark.createDataFrame(rows, "id long, sig array<bigint>"), 0.75).collect()}
    same = {(i, j): sum(x == y for x, y in zip(s, t)) / 128 for i, s in rows for j, t in rows if s and t and i < j}
    assert got == {p: s for p, s in same.items() if s >= 0.75} and got


def test_modes_share_signatures(spark, monkeypatch):
    from sievekit.plans import catalog, dedup_stage as DS
    from helpers import SF001
    made, plain = [], DS.signature_table
    monkeypatch.setattr(DS, "signature_table", lambda *x: made.append(1) or plain(*x))
    assert catalog.dedup_modes(spark, SF001).count() and len(made) == 1


def test_signatures_leave_the_kernel_in_small_batches(spark):
    """A worker holds few rows' signatures at a time, however many rows a batch has; the signatures stay the same."""
    sets = spark.createDataFrame([(i, None if i % 11 == 0 else list(range(i, i + i % 7))) for i in range(1300)], "id long, hashes array<bigint>")

    class Sets:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            batch = pa.RecordBatch.from_pylist([r.asDict() for r in sets.collect()], pa.schema([("id", pa.int64()), ("hashes", pa.list_(pa.int64()))]))
            return list(run(iter([batch, batch.slice(0, 0), batch.slice(5, 700)])))

    out = MH.signatures(Sets(), 16)
    assert max(b.num_rows for b in out) <= 512 and sum(b.num_rows for b in out) == 2000
    want = {r.id: r.sig for r in MH.signatures(sets, 16).collect()}
    assert all(r["sig"] == want[r["id"]] for b in out for r in b.to_pylist())
    assert [i for i, s in want.items() if s is None] == [i for i in range(1300) if i % 11 == 0 or i % 7 == 0]
