"""First-wins dedup: LFMIS semantics, equal-set collapse, invalid rows."""

import random

from pyspark.sql import functions as F

from sievekit.operators import dedup as D
from sievekit.plans import dedup_stage as DS
from helpers import corpus_df


def greedy(n_nodes, edges):
    nb = {}
    for i, j in edges:
        nb.setdefault(j, set()).add(i)
    kept = []
    for v in sorted({x for e in edges for x in e}):
        if not (nb.get(v, set()) & set(kept)):
            kept.append(v)
    return set(kept)


def run_edges(spark, edges):
    df = spark.createDataFrame(edges, "i long, j long")
    st = D.first_wins_edges(df)
    return {r["node"] for r in st.where(F.col("state") == D.KEPT).collect()}


def test_chain_is_not_connected_components(spark):
    assert run_edges(spark, [(1, 2), (2, 3)]) == {1, 3}


def test_lfmis_equals_sequential_greedy(spark):
    rnd = random.Random(7)
    for _ in range(6):
        n = rnd.randint(5, 25)
        edges = sorted({(a, b) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.15})
        if not edges:
            continue
        assert run_edges(spark, edges) == greedy(n, edges)


def test_buckets_equal_clique_greedy(spark):
    rnd = random.Random(3)
    members = [(rnd.randint(0, 30), rnd.randint(0, 12)) for _ in range(60)]
    df = spark.createDataFrame(members, "node long, bucket long")
    st = D.first_wins_buckets(df)
    kept = {r["node"] for r in st.where(F.col("state") == D.KEPT).collect()}
    by_bucket = {}
    for node, b in set(members):
        by_bucket.setdefault(b, set()).add(node)
    edges = {(a, b) for ms in by_bucket.values() for a in ms for b in ms if a < b}
    assert kept == greedy(0, sorted(edges))


TEXT = " ".join(f"w{i}" for i in range(40))


def test_equal_sets_first_kept_and_short_dropped(spark):
    c = corpus_df(spark, [(0, [TEXT]), (1, [TEXT]), (2, ["a b c d"]), (3, [TEXT]), (4, ["zz " * 3 + "q r s t u v"])])
    res = DS.exact_dedup(c, 0.8, 5)
    assert {r[0] for r in res.kept.collect()} == {0, 4}
    links = {(r[0], r[1], r[2]) for r in res.links.collect()}
    assert links == {(1, 0, 1.0), (3, 0, 1.0)}
    st = res.stats().first()
    assert (st["original_count"], st["valid_count"], st["deduplicated_count"], st["duplicate_count"]) == (5, 4, 2, 2)


def test_near_copy_links_to_smallest_kept(spark):
    base = [f"t{i}" for i in range(60)]
    near = base[:-1] + ["other"]
    c = corpus_df(spark, [(5, [" ".join(base)]), (6, [" ".join(near)]), (9, ["x y z w v u"])])
    res = DS.exact_dedup(c, 0.8, 5)
    (link,) = res.links.collect()
    assert (link[0], link[1]) == (6, 5) and 0.8 <= link[2] < 1.0


def walked(rows, similar):
    """{duplicate: smallest kept neighbour} of a walk in ascending index."""
    kept, links = [], {}
    for i, x in rows:
        near = [k for k, y in kept if similar(y, x)]
        if near:
            links[i] = near[0]
        else:
            kept.append((i, x))
    return links


def test_rounds_equal_walk(spark):
    rnd = random.Random(21)
    vocab = [f"v{i}" for i in range(40)]
    rows = []
    for i in range(40):
        base = vocab[(i % 4) * 5:(i % 4) * 5 + 25]
        rows.append((i, [w if rnd.random() > 0.08 else f"z{i}_{j}" for j, w in enumerate(base)]))
    c = corpus_df(spark, [(i, [" ".join(w)]) for i, w in rows])
    sets = [(i, set(zip(w, w[1:], w[2:]))) for i, w in rows]
    for t in (0.5, 0.8):
        got = {r[0]: r[1] for r in DS.exact_dedup(c, t, 3).links.collect()}
        assert got == walked(sets, lambda a, b: len(a & b) / len(a | b) >= t)


def test_minhash_rounds_equal_walk(spark):
    rnd = random.Random(4)
    vocab = [f"m{i}" for i in range(60)]
    rows = []
    for i in range(36):
        base = vocab[(i % 3) * 10:(i % 3) * 10 + 40]
        rows.append((i, [" ".join(w if rnd.random() > 0.05 else f"q{i}_{j}" for j, w in enumerate(base))]))
    c = corpus_df(spark, rows)
    sigs = sorted((r.id, r.sig) for r in DS.signature_table(c, 3).collect())
    got = {r[0]: r[1] for r in DS.minhash_dedup(c, 0.7, 3).links.collect()}
    assert got == walked(sigs, lambda a, b: sum(x == y for x, y in zip(a, b)) / len(a) >= 0.7) and got


def test_chain_of_revisions(spark):
    """Each revision resembles the one before it alone: every second one is kept."""
    words = [f"c{i}" for i in range(400)]
    rows = [(i, [" ".join(words[8 * i:8 * i + 84])]) for i in range(14)]
    res = DS.exact_dedup(corpus_df(spark, rows), 0.8, 5)
    assert {r[0] for r in res.kept.collect()} == {i for i in range(14) if i % 2 == 0}


def test_candidates_stay_below_pairs(spark):
    """Sets of 10 tokens out of 40 (t = 0.8): hardly any is similar, and few pairs are looked at."""
    from sievekit.operators.simjoin import prefix_table
    rnd = random.Random(5)
    rows = [(i, sorted(rnd.sample(range(40), 10)), 10) for i in range(400)]
    docs = spark.createDataFrame(rows, "id long, set array<bigint>, n int")
    p = prefix_table(docs, 0.8)
    lists = p.groupBy("tok").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0]
    assert lists <= 400 * 399 / 2
    state, _ = D.first_wins(docs.select("id", "set"), 0.8)
    assert state.where(F.col("state") == D.KEPT).count() == 400 - len(walked(
        [(i, set(s)) for i, s, _ in rows], lambda a, b: len(a & b) / len(a | b) >= 0.8))


def test_walk_of_components_equals_rounds(spark):
    """Every component in rounds, every one in a task, and a mix give the same links."""
    rnd = random.Random(9)
    rows = []
    for i in range(60):
        base = list(range(100 * (i % 5), 100 * (i % 5) + 20 + 8 * (i % 3)))
        rows.append((i, sorted({v if rnd.random() > 0.1 else 1000 + rnd.randint(0, 400) for v in base})))
    docs = spark.createDataFrame(rows, "id long, set array<bigint>")
    want = walked([(i, set(s)) for i, s in rows], lambda a, b: len(a & b) / len(a | b) >= 0.6)
    for cells in (0, 300, 10 ** 9):
        state, links = D.first_wins(docs, 0.6, giant_cells=cells)
        assert {r.duplicate_index: r.original_index for r in links.collect()} == want
        assert {r.node for r in state.where(F.col("state") == D.DUP).collect()} == set(want)


def test_components(spark):
    edges = [(9, 8), (8, 7), (7, 1), (20, 21), (30, 30)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.label for r in D.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {9: 1, 8: 1, 7: 1, 1: 1, 20: 20, 21: 20} | {100 + i: 100 for i in range(41)}


def test_similar_classes(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(50):
        base = list(range(100 * (i % 4), 100 * (i % 4) + 24))
        rows.append((i, sorted({v if rnd.random() > 0.08 else 1000 + rnd.randint(0, 400) for v in base})))
    rows.append((90, [5000, 5001]))
    near = {i: {j for j, b in rows if j != i and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.7} for i, a in rows}
    least = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in seen and not seen.add(j)]
        least[i] = min(seen)
    docs = spark.createDataFrame(rows, "id long, set array<bigint>")
    for cells in (0, 10 ** 9):
        got = {r.id: (r["class"], r.n_links) for r in D.similar_classes(docs, 0.7, giant_cells=cells).collect()}
        assert got == {i: (least[i], len(near[i])) for i in near}


def test_long_shared_passages_link_nothing(spark):
    """70 sets share 6,000 tokens of 7,600 (Jaccard 0.65): more than any list of heavy tokens holds, and no candidates."""
    docs = spark.range(70).select("id", F.expr(
        "concat(transform(sequence(1, 6000), x -> xxhash64(x)), transform(sequence(1, 1600), x -> xxhash64(id, x)))").alias("set"))
    _, postings, groups = D.candidate_components(docs, 0.8, None, D.GIANT_CELLS)
    assert groups.count() == 0
    assert postings.count() == 0


def test_prefixes_take_tokens_of_few_sets_first(spark):
    from sievekit.operators.simjoin import prefix_table, token_sketch
    docs = spark.range(30).select("id", F.expr(
        "concat(transform(sequence(1, 50), x -> xxhash64(x)), transform(sequence(1, 20), x -> xxhash64(id, x)))").alias("set"),
        F.lit(70).alias("n"))
    assert int(token_sketch(docs).astype(int).sum()) == 30 * 70
    shared = {r[0] for r in spark.range(1, 51).select(F.expr("xxhash64(cast(id as int))")).collect()}
    rows = prefix_table(docs, 0.8).collect()
    assert len(rows) == 30 * 15 and sum(r.tok in shared for r in rows) <= 3  # slots may clash
    assert {r.pos for r in rows} == set(range(15))
    empty = docs.limit(0)
    assert prefix_table(empty, 0.8).count() == 0
