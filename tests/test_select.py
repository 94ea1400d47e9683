"""Quotas (unit form = greedy loops), picks, silhouette."""

import random

from pyspark.sql import functions as F

from sievekit.operators import select as SEL


def loop_quotas(sizes, lo, hi, cap=5):
    """The one-at-a-time definition, used as the brute-force check."""
    n, t = sum(sizes.values()), (lo + hi) // 2
    q = {c: min(max(1, int(s / n * t)), min(s, max(1, min(cap, s // 2)))) for c, s in sorted(sizes.items())}
    total = sum(q.values())
    while total > hi:
        c = max(sorted(q), key=lambda x: q[x])
        if q[c] <= 1:
            break
        q[c] -= 1
        total -= 1
    while total < lo:
        best = None
        for c in sorted(q):
            if q[c] < min(cap, sizes[c]) and (best is None or q[c] > q[best]):
                best = c
        if best is None:
            break
        q[best] += 1
        total += 1
    return q


def spark_quotas(spark, sizes, lo, hi):
    df = spark.createDataFrame(sorted(sizes.items()), "cluster int, size long")
    q = SEL.adjust_quotas(SEL.base_quotas(df, lo, hi), lo, hi)
    return {r["cluster"]: r["quota"] for r in q.collect()}


def test_unit_form_equals_loops(spark):
    rnd = random.Random(11)
    for _ in range(12):
        sizes = {c: rnd.choice([1, 2, 3, 5, 8, 20, 60, 200]) for c in range(rnd.randint(2, 14))}
        lo = rnd.randint(1, 40)
        hi = lo + rnd.randint(0, 10)
        assert spark_quotas(spark, sizes, lo, hi) == loop_quotas(sizes, lo, hi)


def test_skewed_fixture_trim_and_fill(spark):
    sizes = {c: s for c, s in enumerate([1, 2, 4, 8, 16, 32, 64, 128, 245])}
    base = SEL.base_quotas(spark.createDataFrame(sorted(sizes.items()), "cluster int, size long"), 10, 11)
    assert sum(r["quota"] for r in base.collect()) == 13
    assert sum(spark_quotas(spark, sizes, 10, 11).values()) == 11
    base2 = SEL.base_quotas(spark.createDataFrame(sorted(sizes.items()), "cluster int, size long"), 30, 34)
    assert sum(r["quota"] for r in base2.collect()) == 21
    assert sum(spark_quotas(spark, sizes, 30, 34).values()) == 30


def test_capped_clusters_miss_target(spark):
    rows = [(i, c, [float(c), float(i % 7)]) for c in range(15) for i in range(c * 20, c * 20 + 20)]
    pts = spark.createDataFrame(rows, "id long, cluster int, features array<double>")
    q = SEL.quotas(pts, 80, 120)
    picks = SEL.select_representatives(pts, q)
    a = SEL.selection_analysis(picks, pts, 80, 120).first()
    assert a["selected_count"] == 75 and not a["target_met"] and a["covered_clusters"] == 15
    assert picks.select("id").distinct().count() == 75


def test_fps_ties_and_duplicate_points(spark):
    # centre member is id 1 (x=0); ids 0 and 2 are equally far -> lower id first
    rows = [(0, 0, [-1.0]), (1, 0, [0.0]), (2, 0, [1.0]), (3, 0, [0.0]), (4, 0, [0.0]),
            (10, 1, [5.0]), (11, 1, [5.0]), (12, 1, [5.0]), (13, 1, [5.0]), (14, 1, [5.0]), (15, 1, [5.0])]
    pts = spark.createDataFrame(rows, "id long, cluster int, features array<double>")
    q = spark.createDataFrame([(0, 5, 3), (1, 6, 3)], "cluster int, size long, quota int")
    picks = SEL.select_representatives(pts, q)
    got = {(r["cluster"], r["pick_rank"]): r["id"] for r in picks.collect()}
    assert [got[(0, k)] for k in (1, 2, 3)] == [1, 0, 2]
    assert [got[(1, k)] for k in (1, 2, 3)] == [10, 11, 12]  # all equal: quota still filled


def test_silhouette_closed_form_matches_pairs(spark):
    rnd = random.Random(5)
    rows = [(i, i % 3, [rnd.random() + (i % 3), rnd.random()]) for i in range(30)]
    pts = spark.createDataFrame(rows, "id long, cluster int, features array<double>")
    got = SEL.silhouette_sq_euclidean(pts).first()[0]
    def d(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))
    s = []
    for i, c, f in rows:
        own = [d(f, g) for j, cc, g in rows if cc == c and j != i]
        other = min(sum(d(f, g) for j, cc, g in rows if cc == k) / sum(1 for _, cc, _ in rows if cc == k)
                    for k in {0, 1, 2} - {c})
        a = sum(own) / len(own)
        s.append((other - a) / max(a, other))
    assert abs(got - sum(s) / len(s)) < 1e-9


def test_silhouette_guards(spark):
    same = spark.createDataFrame([(i, i % 2, [1.0, 2.0]) for i in range(6)], "id int, cluster int, features array<double>")
    assert SEL.silhouette_sq_euclidean(same).first()[0] == 0.0
    one = spark.createDataFrame([(i, 0, [float(i)]) for i in range(4)], "id int, cluster int, features array<double>")
    assert SEL.silhouette_sq_euclidean(one).first()[0] == 0.0
    assert SEL.silhouette_sq_euclidean(one.limit(0)).first()[0] == 0.0


def test_more_clusters_than_a_block(spark, monkeypatch):
    rows = [(i, i % 7, [float(i % 7), float(i)]) for i in range(70)]
    pts = spark.createDataFrame(rows, "id int, cluster int, features array<double>")
    whole = SEL.silhouette_sq_euclidean(pts).first()[0]
    near = {r.id: r.cluster for r in SEL.assign_nearest(pts, SEL.centres(pts)).collect()}
    monkeypatch.setattr(SEL, "BLOCK_CLUSTERS", 2)
    assert abs(SEL.silhouette_sq_euclidean(pts).first()[0] - whole) < 1e-12
    assert {r.id: r.cluster for r in SEL.assign_nearest(pts, SEL.centres(pts)).collect()} == near


def test_empty_selection_is_reported(spark):
    pts = spark.createDataFrame([], "id int, cluster int, features array<double>")
    picks = spark.createDataFrame([], "id int, cluster int, pick_rank int")
    r = SEL.selection_analysis(picks, pts, 1, 2).first()
    assert (r.selected_count, r.coverage_ratio, r.target_met) == (0, 0.0, False)
    assert SEL.selection_metrics(picks, pts).first()[:] == (0, 0, 0.0, 100.0)


def test_first_best_takes_the_lowest_k(spark):
    scores = spark.createDataFrame([(5, 0.3), (3, 0.3), (9, 0.1)], "k int, silhouette double")
    assert SEL.first_best(scores).first()["k"] == 3
