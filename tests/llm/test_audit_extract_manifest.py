"""Source audit, page text and dataset manifest against brute force, and their defined cases."""

import html
import itertools
import random
import re

import numpy as np
import pytest

from sievekit.llm import html_extract as X
from sievekit.llm import merkle_manifest as M
from sievekit.llm import source_audit as A

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, source string, lang string, n_chars long, text string"
ROWS = "lang string, source string, text string"


# ---- operator 11 ----

def test_transducer_is_minimal_and_ordered():
    rnd = random.Random(1)
    for _ in range(40):
        keys = sorted({bytes(rnd.choice(b"abc\xc3") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 150))})
        t = A.Transducer.unpack(A.Transducer.build(keys).pack())
        assert t.ordinals(keys).tolist() == list(range(len(keys)))
        assert [t.key(i) for i in range(len(keys))] == keys
        other = [bytes(rnd.choice(b"abcd") for _ in range(rnd.randint(1, 7))) for _ in range(60)]
        assert t.ordinals(other).tolist() == [keys.index(o) if o in keys else -1 for o in other]
        # as many states as different sets of endings
        endings = {frozenset(k[n:] for k in keys if k[:n] == p) for p in {k[:n] for k in keys for n in range(len(k) + 1)} for n in [len(p)]}
        assert len(t.final) == len(endings)
    with pytest.raises(ValueError):
        A.Transducer.build([b"b", b"a"])


def test_share_is_exact_for_huge_counts():
    for c, n, v in ((0, 0, 1), (7, 10 ** 12, 10 ** 6), (10 ** 14 - 1, 10 ** 14, 3), (123456789, 987654321, 55)):
        assert int(A.share(np.array([c], np.int64), n, v)[0]) == 1 + A.SCALE * (c + 2) // (n + 2 * v)


@pytest.mark.parametrize("small", [{}, {"shard_keys": 7, "block_terms": 3, "part_terms": 20}])
def test_audit_equals_brute_force(spark, small):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 3)))
    rows = [(rnd.choice(["en", "de", None, "e\0n"]), rnd.choice(["s1", "s2", "ß", None]), " ".join(word().upper() for _ in range(rnd.randint(0, 60))))
            for _ in range(150)]
    rows += [("en", "hot", "the The THE x1y")] * 80  # a third of all rows, and repeated rows
    rows += [("xx", "only", "rare"), ("yy", "a", None), ("yy", "b", ""), (None, None, None), ("en", "s1", "long " * 5000)]
    df = spark.createDataFrame(rows, ROWS)
    got = sorted(tuple(r) for r in A.audit_sources(df, **small).collect())
    assert got == sorted(A.brute_force(rows))
    assert ("yy", "a", "pair", "b", 0, 1) in got and not [r for r in got if r[0] == "xx"]


def test_audit_of_nothing_and_clashing_names(spark):
    assert A.audit_sources(spark.createDataFrame([], ROWS)).collect() == []
    rows = [("en", s, "alpha beta") for s in "ab" * 12]
    plain = spark.createDataFrame(rows, ROWS)
    more = plain.selectExpr("*", "1 as shard", "2 as key", "3 as part", "4 as value", "5 as item")
    assert sorted(A.audit_sources(more).collect()) == sorted(A.audit_sources(plain).collect())


# ---- operator 12 ----

def test_minimum_cut_is_the_least_of_all():
    rnd = random.Random(3)
    for _ in range(300):
        n = rnd.randint(1, 8)
        t = [rnd.randint(-6, 6) for _ in range(n)]
        edges = [(a, b, rnd.randint(0, 4)) for a in range(n) for b in range(a) if rnd.random() < .6]
        cost = lambda s: (sum(max(-x, 0) if k else max(x, 0) for x, k in zip(t, s))
                          + sum(c for a, b, c in edges if s[a] != s[b]))
        assert cost(X.minimum_cut(t, edges)) == min(cost(s) for s in itertools.product([False, True], repeat=n))


def plain_article(page: str) -> str:
    """Text between the article tags, for pages whose articles hold paragraphs alone."""
    m = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    inside = re.sub(r"<[^>]*$", "", m.group(1)) if m else ""
    return " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inside).replace("<b>", "")).split())


def test_pages_of_the_table(spark):
    got = {r.page_id: r for r in X.op12_html_extract(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(pages) == len(got)
    for p in pages:
        assert (got[p.page_id].url, got[p.page_id].text) == (p.url, plain_article(p.html))
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p {x: "</p>"}</style></head><body class="has-sidebar">
<header><h1>Site</h1><a href="/">home</a></header><div id="content-sidebar-wrap"><div class="cookie-notice"><p>We use cookies on this site.</p></div>
<div class="post"><h1>A title</h1><p>First paragraph of
 the text, with words enough to count as one.</p><div class="ad">Buy this now, it is the best there is!</div><p>Second paragraph, long enough too.
<p>Third &amp; last&#33;<br>one, w<b>or</b>d. <span class="share">Share it</span><!-- no --></div><aside>More stories of the day, by our writers.</aside>
<div class="comments"><article class="comment"><p>I like this text a lot, thank you for it.</p></article></div>
<form><label>Name</label><select><option>a<option>b</select></form></div><footer><p>c 2020</p></footer><script>if (a<b) "</p>"</script>"""


def test_page_without_article_element():
    w = np.array(X.START_WEIGHTS)
    assert X.main_text(PAGE, w) == ("A title First paragraph of the text, with words enough to count as one. "
                                    "Second paragraph, long enough too. Third & last! one, word.")
    for broken in ("", "<", "<!-- x", "<script>x", "<p", "<p>&nbsp;</p>", "<a href=\"x", "</", "<article></article>"):
        assert X.main_text(broken, w) == ""
    assert X.main_text("<article><p>A word &amp more &am", w) == "A word & more &am"
    deep = "<div>" * 3000 + "<article>" + "<p>some words here." * 3000
    assert X.main_text(deep, w) == " ".join(["some words here."] * 3000)


def test_training_moves_the_weights_and_stays_near_without_rows():
    assert X.train([]).tolist() == list(X.START_WEIGHTS)
    rows = [(True, 5.0, 0.0, 1.0, 0.0, 0.0, 900), (False, 5.0, 0.9, 1.0, 0.0, 0.0, 900), (False, 2.0, 1.0, 0.0, 0.0, 1.0, 500)]
    w = X.train(rows)
    score = lambda *x: float(np.dot(w, (1.0, *x)))
    assert score(5, 0, 1, 0, 0) > 2 and score(5, 0.9, 1, 0, 0) < -2


def test_extraction_of_odd_rows(spark):
    rows = [(1, "u", "<article><p>One two three.</p></article>")] * 3 + [(None, None, None), (2, None, ""), (3, "v", "<p>" * 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "7 as text", "8 as n_chars", "9 as k")
    got = sorted((tuple(r) for r in X.extract_text(df).collect()), key=repr)
    assert got == sorted([(1, "u", "One two three.", 14)] * 3 + [(None, None, "", 0), (2, None, "", 0), (3, "v", "", 0)], key=repr)
    assert X.extract_text(df.limit(0)).collect() == []


# ---- operator 13 ----

def rows_of(n):
    rnd = random.Random(n)
    rows = [dict(doc_id=i, source=rnd.choice(["s", None, "é"]), lang=rnd.choice(["en", "de", None]), n_chars=rnd.choice([3, None]), text="t" * (i % 5))
            for i in range(n)]
    return rows + [dict(doc_id=None, source=None, lang=None, n_chars=None, text=None)] * 2 + [
        dict(doc_id=5, source="x", lang="zz", n_chars=2 ** 63 - 1, text="é"), dict(doc_id=5, source="y", lang="en", n_chars=1, text="long " * 20000)]


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_manifest_equals_brute_force(spark, bits):
    from pyspark.sql import functions as F

    rows = rows_of(70)
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as grp", "2 as pos", "3 as leaf", "4 as node")
    p = M.prove(M.document_leaves(df), bits=bits)
    got = [tuple(r) for r in p.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256), "folded_root",
                                      F.expr("folded_root = root")).collect()]
    want = M.brute_force(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[-1] for r in want} == {True, False}


def test_versions_copy_their_paths_alone(spark):
    rows = [dict(doc_id=i, source="s", lang="en", n_chars=1, text=str(i)) for i in range(100)]
    proven = M.prove(M.document_leaves(spark.createDataFrame(rows, DOC)), bits=3, with_copies=True).collect()
    leaves = [r.leaf.encode() for r in sorted(proven, key=lambda r: r.doc_id)]
    changed = 0
    for r in proven:
        if r.copies is None:
            assert r.folded_root == r.root
            continue
        changed += 1
        whole = M.BlockTree([c if i != r.doc_id else r.copies[0].digest.encode() for i, c in enumerate(leaves)], 7)
        own = {(c.level, c.place): c.digest for c in r.copies}
        assert len(own) == 8 and all(whole.levels[a][b].decode() == d for (a, b), d in own.items())
        assert r.folded_root == whole.top.decode()
        base = M.BlockTree(leaves, 7)
        assert all(x == y for k, (p, q) in enumerate(zip(base.levels, whole.levels)) for j, (x, y) in enumerate(zip(p, q)) if (k, j) not in own)
    assert changed


def test_manifest_of_small_tables(spark):
    assert M.prove(M.document_leaves(spark.createDataFrame([], DOC))).collect() == []
    one = [dict(doc_id=1, source="s", lang="en", n_chars=1, text="t")]
    r = M.prove(M.document_leaves(spark.createDataFrame(one, DOC))).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof == []
