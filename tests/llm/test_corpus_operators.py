"""Corpus operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from sievekit.llm import bm25_search, lm_score, lsh_forest, mixing, quality, suffix_dedup, url_filter
from sievekit.llm.common import Scratch

SF = "/root/testdata/sf0.001"
CLASH = "k1 long, h string, score string, size string, node string, block string, rank string, term string"


def table(spark, rows):
    """(doc_id, text) rows with further columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASH.split(", ")))


def key(row):
    return tuple((x is None, x) if not isinstance(x, float) else (False, round(x, 6)) for x in (row[0] is None, row[0] or 0, *row[1:]))


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


ODD = [(9000, None), (9001, ""), (9002, "a b"), (9003, "A b"), (9004, " \t "), (None, "a b"), (9005, "x y x"), (9005, "x y x")]


# --- URL filter -----------------------------------------------------------------------------------------------

def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for h, p, v in rules:
        p = p or ""
        if h is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p):
            rank = (len(h + p), len(h), v == "block")
            best = max(best or (rank, h.lower() + p, v), (rank, h.lower() + p, v))
    return host, path, best and best[1], best[2] if best else default


def test_url_filter_equals_brute_force(spark):
    rng = random.Random(0)
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "xexample.org", "com", "fr.com", "x-y.com", "EXAMPLE.Com", "", ".org", "org.", "é.org"]
    paths = ["", "/", "/es/", "/es/x", "/en/1", "/en/12?q=/x", "/fr/#/de/", "?a://b", "/de"]
    rules = [*url_filter.RULES, ("a.example.org", "/es/x", "allow"), ("a.example.org", "/es/x", "block"), (None, "/", "block"),
             ("EXAMPLE.com", None, "block"), ("org", "/es/xyzw", "block"), ("org", "", "block")]
    urls = [None, "", "no scheme", "http://", *(f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400))]
    rows = [(i if i % 50 else None, u, "clash", "clash") for i, u in enumerate(urls)] + [(1, urls[1], "", "")] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = url_filter.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    want = [(i, *judged(u, rules)) for i, u, *_ in rows]
    assert sorted(map(key, (tuple(r) for r in got.collect()))) == sorted(map(key, want))
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filter.filter_urls(pages, none, default="block").collect()} == {"block"}
    assert url_filter.filter_urls(pages.limit(0), none).count() == 0


# --- quality --------------------------------------------------------------------------------------------------

def plain_stats(text):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = list(zip(words, words[1:], words[2:]))
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))


def test_quality_statistics(documents):
    for _, text in [*documents[:60], *ODD, (0, "a b c a b c"), (0, "l\nl\n \n \nl"), (0, "é" * 9 + " #|")]:
        assert quality.text_stats((text or "").encode())[:5] == plain_stats(text)


def test_quality_verdicts_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train = labels.where("doc_id % 2 = 0")
    judged = quality.judge_quality(docs, train).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r.kept for r in judged if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in judged if r.quality == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.05


def test_quality_odd_rows(spark, documents):
    labels = spark.createDataFrame([(documents[0][0], 1), (None, 0), (documents[1][0], None)], "doc_id long, quality int")
    rows = documents[:20] + ODD
    got = quality.judge_quality(table(spark, rows), labels).collect()  # too few labels: the base rules decide
    assert sorted((r.doc_id is None, r.doc_id or 0, r.kept) for r in got) == sorted(
        (i is None, i or 0, s[0] >= 50 and 100 * s[4] <= 50 * s[0]) for i, s in ((i, plain_stats(t)) for i, t in rows))
    assert quality.judge_quality(table(spark, []), labels).count() == 0


# --- BM25 -----------------------------------------------------------------------------------------------------

def test_search_equals_brute_force(spark, documents, monkeypatch):
    import math
    from collections import Counter

    rows = documents[:80] + ODD + [(9100, documents[0][1]), (9101, documents[0][1])]
    bags = [(i, Counter("".join(c.lower() if c.isascii() else c for c in t or "").encode().split())) for i, t in rows]
    n, df = len(bags), Counter(w for _, b in bags for w in b)
    mean = sum(sum(b.values()) for _, b in bags) / n
    part = lambda b, w: (math.log(1 + (n - df[w] + .5) / (df[w] + .5)) * b[w] * 2.2 / (b[w] + 1.2 * (.25 + .75 * sum(b.values()) / mean)))
    want = {}
    for q, bag in bags:
        if q is None or q % 3:
            continue
        scored = sorted(((-round(sum(part(b, w) for w in bag if w in b), 6), i is None, i or 0) for i, b in bags if set(bag) & set(b)))
        want[q] = [(-s, None if no else i) for s, no, i in scored[:10]]
    for shard in (8192, 7):  # one shard a partition, and many
        monkeypatch.setattr(bm25_search, "SHARD_DOCS", shard)
        df_ = table(spark, rows)
        got = {}
        for r in bm25_search.search(df_, df_.where("doc_id % 3 = 0")).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.score, r.doc_id))
        assert got == {q: x for q, x in want.items() if x}
    assert bm25_search.search(table(spark, []), table(spark, rows)).count() == 0


def test_search_tasks_are_partitions_by_themselves(spark, monkeypatch):
    """No two of the parts of shards and queries share a partition, whatever the shuffle partitions."""
    seen, write = [], Scratch.write

    def watched(self, df, name, *more):
        if name == "found":
            seen.append(df.rdd.getNumPartitions())
        return write(self, df, name, *more)

    monkeypatch.setattr(Scratch, "write", watched)
    docs = table(spark, [(i, f"w{i % 5} w{i % 7} x{i}") for i in range(70)]).repartition(7)
    assert docs.count() == 70 and bm25_search.search(docs, docs.where("doc_id % 10 = 0")).count() == 70
    assert seen == [7]


def test_blocks_that_cannot_reach_the_list_are_not_read(monkeypatch):
    """Tiny blocks: postings are skipped, and the lists equal those of all scores."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(bm25_search, "BLOCK_DOCS", 4)
    monkeypatch.setattr(bm25_search, "SLICE_ENTRIES", 40)
    rng = random.Random(8)
    for dense in (0.02, 0.4, 2.0):
        monkeypatch.setattr(bm25_search, "DENSE", dense)
        bags = [{rng.randint(0, 3000) + 4000 * (i // 40): rng.randint(1, 3) for _ in range(rng.randint(1, 40))} | {-1 % 2 ** 32: 1} for i in range(200)]
        terms = sorted({t for b in bags for t in b})
        posts = [[(d, b[t]) for d, b in enumerate(bags) if t in b] for t in terms]
        lengths = np.array([sum(b.values()) for b in bags], np.uint32)
        mean = float(lengths.mean())
        packed = [bm25_search.planes(np.array(x, k)) for x, k in (
            (lengths, np.uint32), (np.diff(np.array(terms, np.uint64), prepend=np.uint64(0)), np.uint64), ([len(x) for x in posts], np.uint32),
            ([d for x in posts for d, _ in x], np.uint32), ([c for x in posts for _, c in x], np.uint32))]
        shard = bm25_search.Shard(pa.array(range(200)), *packed, mean)
        shard.rank = np.append(np.array(shard.ids.to_pylist()), 200)
        shard.measure = True
        idf = {t: float(np.log(1 + (200 - len(x) + .5) / (len(x) + .5))) for t, x in zip(terms, posts)}
        asked = [rng.sample(terms[:-1], 6) + [terms[-1]] for _ in range(30)] + [list(bags[i]) for i in (0, 60, 199)] + [[7], []]
        flat = np.array([t for q in asked for t in q], np.uint64)
        distinct, first, where = np.unique(flat, return_index=True, return_inverse=True)
        weights = np.array([idf.get(int(t), 1.0) for t in flat])[first]
        q, d, score = shard.search(np.array([len(x) for x in asked]), distinct, weights, where, 3, np.zeros(len(asked)))
        ids = shard.ids.to_pylist()
        got = [[(s, ids[x]) for qq, x, s in zip(q.tolist(), d.tolist(), score.tolist()) if qq == i] for i in range(len(asked))]
        for terms_asked, mine in zip(asked, got):
            every = sorted((-round(sum(idf[t] * b[t] * 2.2 / (b[t] + 1.2 * (.25 + .75 * sum(b.values()) / mean)) for t in terms_asked if t in b), 6), i)
                           for i, b in enumerate(bags) if any(t in b for t in terms_asked))
            assert mine == [(-s, i) for s, i in every[:3]]
        assert 0 < shard.read < 0.6 * shard.postings


def test_queries_of_equal_id_and_different_texts(spark):
    docs = table(spark, [(i, f"{'red' if i < 20 else 'blue'} w{i}") for i in range(40)])
    asked = lambda *rows: sorted((r.query_id, r.rank, r.doc_id, r.score) for r in bm25_search.search(docs, table(spark, rows)).collect())
    red, blue = asked((7, "red w3")), asked((7, "blue w3"))
    assert len(red) == 10 and len(blue) == 10 and red != blue
    assert asked((7, "red w3"), (7, "blue w3"), (7, "red w3")) == sorted(red + blue)


# --- Jaccard join ---------------------------------------------------------------------------------------------

def near_copies(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(rng.randint(30, 300))] for _ in range(25)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(w) // 60))):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((i, " ".join(w)))
    return out


def test_least_depth_reaches_recall():
    d = lsh_forest.least_depth()
    assert 1 - (1 - lsh_forest.SIMILARITY ** d) ** lsh_forest.TREES >= lsh_forest.TARGET_RECALL


def test_jaccard_join_equals_brute_force(spark, documents):
    for rows, kw in ((near_copies(300) + ODD, {}), (near_copies(300) + ODD, {"block_nodes": 15}), (documents, {}), ([], {})):
        got = lsh_forest.near_duplicates(table(spark, rows), **kw).select("doc_id", "class_id", "n_links", "n_copies").collect()
        links, want = lsh_forest.brute_force(rows)
        found, there = sum(r.n_links for r in got), sum(map(len, links.values()))
        assert found >= 0.99 * there and sorted(map(key, map(tuple, got))) == sorted(map(key, want))


# --- language model -------------------------------------------------------------------------------------------

def test_scores_equal_brute_force(spark, documents, monkeypatch):
    for rows, tokens in ((documents[:60] + ODD, 2_500_000), (documents[:60] + ODD, 900), ([(0, "a b a")], 10), ([], 10)):
        monkeypatch.setattr(lm_score, "BLOCK_TOKENS", tokens)
        monkeypatch.setattr(lm_score, "RANGE_KEYS", 10 * tokens if tokens > 1000 else 500)
        got = sorted(map(key, (tuple(r) for r in lm_score.score_texts(table(spark, rows)).collect())))
        want = sorted(map(key, lm_score.brute_force(rows)))
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert a[:7] == b[:7]
            assert all(abs(x[1] - y[1]) <= 1e-5 for x, y in zip(a[7:], b[7:]))


def test_mixing_beats_the_base_model_on_held_out_text(spark):
    got = lm_score.op6_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_texts_not_to_learn_from_change_no_score_of_others(spark, documents):
    import zlib

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    rows = documents[:120]
    other = [(i, "quite another text " + str(i) if held(i) else t) for i, t in rows]
    scores = [{r.doc_id: r for r in lm_score.score_texts(table(spark, x)).collect()} for x in (rows, other)]
    assert sum(map(held, scores[0])) > 5
    for i in scores[0]:
        a, b = scores[0][i], scores[1][i]
        assert a.train_tokens == b.train_tokens
        if not held(i):
            assert (a.score, a.base_score) == (b.score, b.base_score)


# --- suffix arrays --------------------------------------------------------------------------------------------

def passages(seed=3):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcdef ghé") for _ in range(rng.randint(380, 900))) for _ in range(6)]
    rows = []
    for i in range(60):
        t = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 600)))
        for _ in range(rng.randint(0, 2)):
            t += rng.choice(shared)[rng.randint(0, 60):] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60)))
        rows.append((i, t))
    rows += [(30000 + i, "".join(rng.choice("uvw") for _ in range(rng.randint(0, 200))) + shared[0][:390]
              + ("XX" if i % 3 else "Y" * 16) + "".join(rng.choice("uvw") for _ in range(rng.randint(0, 100)))) for i in range(50)]
    return rows + [(20000, "a" * 1500), (20001, "a" * 399), (20002, "a" * 400), (20003, "ab" * 500), (20004, "\0" * 900),
                   (20006, "dup" + shared[1]), (20006, "dup" + shared[1])]


def test_suffix_order_and_prefixes():
    import numpy as np

    rng = random.Random(0)
    for text in (b"", b"a", b"banana" * 30, bytes(rng.choices(b"ab\0", k=700)), b"\0" * 50):
        raw = np.frombuffer(text, np.uint8)
        order, place = suffix_dedup.suffix_order(raw) if len(raw) else (np.zeros(0, int), np.zeros(0, int))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        if len(raw):
            got = suffix_dedup.common_prefixes(raw, order, place, np.array([0]), np.array([len(raw)]), 40)
            for i in range(1, len(text)):
                a, b = text[order[i - 1]:], text[order[i]:]
                same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                # past the end of the last context there are only zeros
                assert got[i] == min(same, 40) or (min(len(a), len(b)) == same and got[i] >= same)


def test_repeated_passages_equal_brute_force(spark, documents):
    for rows, kw in ((passages() + ODD, {}), (passages() + ODD, {"shard_occurrences": 3, "shard_bytes": 3000, "hot_occurrences": 4}), (documents[:80], {}), ([], {})):
        docs = table(spark, rows)
        cut = suffix_dedup.repeated_passages(docs, **kw).select("k1", "k2", "spans", F.sha2("kept", 256).alias("sha"))
        text = F.coalesce("text", F.lit(""))
        whole = docs.select("doc_id", *suffix_dedup.document_key("doc_id", "text"), F.octet_length(text).alias("n"), F.sha2(text, 256).alias("whole"))
        got = [(r.doc_id, r.n, sum(x.e - x.s for x in r.spans or []), len(r.spans or []), r.sha or r.whole)
               for r in whole.join(cut, ["k1", "k2"], "left").collect()]
        assert sorted(map(key, got)) == sorted(map(key, suffix_dedup.brute_force(rows)))


def test_long_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghij ") for _ in range(6000))
    rows = [(1, long), (2, "x" + long[500:5000]), (3, long[2000:2450])]
    cut = suffix_dedup.repeated_passages(table(spark, rows)).collect()
    want = {r[4] for r in suffix_dedup.brute_force(rows)}
    import hashlib
    assert {hashlib.sha256(bytes(r.kept)).hexdigest() for r in cut} == want


# --- mixing ---------------------------------------------------------------------------------------------------

def mixed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target string")
    return mixing.mix_sources(df)


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(0, 30)), rng.choice(["a", "a", "a", "b", "c", "d", "é", None]), "clash", "clash") for i in range(500)]
    rows += [(1, "x y z", "a", "", "")] * 3 + [(None, None, None, "", ""), (600, "", "zero", "", "")]
    got = mixed(spark, rows).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixed(spark, rows).collect()), key=repr)
    total = sum(r.size for r in got)
    sums = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        t = sums.setdefault((r.source_size, r.target), [0])
        t[0] += r.taken
    for (size, target), (taken,) in sums.items():
        assert target <= 2 * size and abs(taken - target) < 1
    assert abs(sum(t for _, t in sums) - 1.5 * total) < 1e-6 * total
    assert mixed(spark, []).count() == 0


def test_targets_reshare_excess(spark):
    # weights 3, 1, 2: the first source cannot take its share of 150 %
    rows = [(0, "w " * 10, "a", "", ""), (1, "w " * 100, "b", "", ""), (2, "w " * 100, "c", "", "")]
    got = {r.doc_id: (r.target, r.taken) for r in mixed(spark, rows).collect()}
    assert got[0] == (20.0, 20) and abs(got[1][0] - (315 - 20) / 3) < 1e-9 and abs(got[2][0] - 2 * (315 - 20) / 3) < 1e-9


def test_prefix_sums_over_ranges(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("v"))
    rows, offsets = mixing._with_prefix(Scratch(spark, "test"), df, "t", ["g"], ["id"], "v")
    got = {r.id: r.offset + r.before_in for r in rows.join(offsets, ["g", "_pid"]).collect()}
    for i in range(1000):
        assert got[i] == sum(j % 7 for j in range(i) if j % 3 == i % 3)
