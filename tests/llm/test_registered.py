"""Registered queries and the pipeline on the smallest tables."""

import hashlib
from collections import Counter

import duckdb
import pandas as pd
import pytest

import __spark_entry__
import corpus_pipeline
from sievekit.llm import bpe_codec, lsh_forest, mixing, quality, queries, suffix_dedup

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "labels")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    got = queries.REGISTRY[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    norm = lambda rows: sorted([tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows], key=repr)
    assert norm(got.select(*names).collect()) == norm(want.fetchall())


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


def test_near_duplicate_stage_keeps_one_of_equal_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, "en", "s", 1)] * 4 + [(0, text + " x", "en", "s", 1), (5, None, "en", "s", 1), (6, "", "en", "s", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in got) == [0, 5, 6]


def cut_passages(rows, size=corpus_pipeline.PASSAGE_BYTES, words=corpus_pipeline.PASSAGE_WORDS):
    """By id: the text without the characters that a run of repeated windows touches, and whether there is such a run."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[p:p + size] for _, t in raw for p in range(len(t) - size + 1))
    out = {}
    for (i, text), (_, t) in zip(rows, raw):
        gone = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if count[t[p:p + size]] > 1:
                gone[p:p + size] = b"\1" * size
        at = 0
        while (a := gone.find(1, at)) >= 0:
            at = gone.find(0, a)
            at = len(t) if at < 0 else at
            if len(t[a:at].split()) < words:
                gone[a:at] = bytes(at - a)
        at, left = 0, []
        for c in text or "":
            n = len(c.encode())
            if not any(gone[at:at + n]):
                left.append(c)
            at += n
        out[i] = "".join(left), any(gone)
    return out


def test_passage_stage_drops_only_split_characters(spark):
    words = lambda start, seed: " ".join("".join(chr(start + (i * i * seed + 7 * i + j * 5) % 30) for j in range(6)) for i in range(60))
    cyrillic, cjk, own = words(0x430, 11), words(0x4E00, 13), lambda start, n: "".join(chr(start + (n * j) % 29) for j in range(1, 20))
    rows = [
        # the next letters share the lead byte 0xD0, so the cut ends inside them
        (1, "first " + cyrillic + "абв one"), (2, "second " + cyrillic + "где two"),
        # the letters before it share the last bytes (0xD0 0xB1 and 0xD1 0xB1), so the cut begins inside them
        (3, "three \u0431" + words(0x61, 3) + " three"), (4, "four \u0471" + words(0x61, 3) + " four"),
        (5, own(0x4E00, 3) + cjk + "\u4e01 five \ufffd"), (6, own(0x4E00, 5) + cjk + "\u4e02 six"),
        (7, "seven \ufffd ж"), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.passage_dedup(spark, docs, SF).collect()}
    assert sorted(got) == list(range(1, 9))
    want = cut_passages(rows)
    assert {i: got[i].text or "" for i in got} == {i: t for i, (t, _) in want.items()}
    assert all(got[i].n_chars == (len(t) if gone else 1) for i, (t, gone) in want.items())
    assert sum(gone for _, gone in want.values()) == 6 and got[5].text.endswith("five \ufffd")


def test_passages_of_51_words_go_and_shorter_ones_stay(spark):
    rng = __import__("random").Random(4)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, planted = [], {}
    for k, n in enumerate((51, 55, 60, 70, 80, 47, 40, 30)):
        passage = text(n)
        assert len(passage.encode()) >= corpus_pipeline.PASSAGE_BYTES or n < 49
        for i in (2 * k, 2 * k + 1):
            before, after = text(60) + f" q{i}z", f"z{i}q " + text(60)
            rows.append((i, f"{before} {passage} {after}"))
            planted[i] = (n, before, after)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.passage_dedup(spark, docs, SF).collect()}
    for i, t in rows:
        n, before, after = planted[i]
        if n <= 50:
            assert got[i] == t
        else:  # letters next to the passage go with it where both texts have the same
            assert got[i].startswith(before[:-2]) and got[i].endswith(after[2:]) and len(got[i]) <= len(before + after)


def test_stages_on_odd_tables(spark):
    """Empty tables, repeated rows, nulls, and columns that have the names used inside."""
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", "s", 1)] * 3 + [(None, None, None, None, None), (2, "", "en", "s", 0), (3, text[::-1], "en", None, 2)]
    clash = [*("kept _kept _k1 _k2 _copy k1 k2 class row copies spans h score words size".split())]
    for given in ([], rows):
        docs = spark.createDataFrame(given, columns).selectExpr("*", *(f"{n} as `{c}`" for n, c in enumerate(clash)))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            got = out.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
                assert all(list(r)[5:] == list(range(len(clash))) for r in got)
            ids = Counter(r.doc_id for r in got)
            if name == "n-gram Jaccard join" and given:
                assert ids == {1: 1, None: 1, 2: 1, 3: 1}
            elif name == "suffix-array dedup" and given:
                assert ids == {None: 1, 2: 1, 3: 1}  # what repeats as a whole goes
            elif name == "BPE encoding and decoding":
                assert sum(ids.values()) == len(given)
            elif not given:
                assert not got


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    """Whole row sets of every stage, each computed from the rows that the stage got."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, inputs, outputs = spark.read.parquet(f"{SF}/documents.parquet"), {}, {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        if name == "suffix-array dedup":  # two texts whose cut ends inside letters of one lead byte
            passage = " ".join("абвгдежзик"[i % 10:] + "лмнопрстуф"[i % 7:] for i in range(60))
            more = [(10 ** 9 + i, f"own{i} " + passage + end, "ru", "s", 1) for i, end in enumerate(("аб один", "вг два"))]
            docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
        inputs[name] = [r.asDict() for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        outputs[name] = [r.asDict() for r in docs.collect()]
    whole = lambda rows: sorted((tuple(r[c] for c in columns) for r in rows), key=repr)

    # quality: base rules and the forest's cut-off from labelled rows, in plain Python
    rows = inputs["quality rules"]
    names = quality._names(quality.STATS, quality.MORE)
    stats = pd.DataFrame([quality.text_stats((r["text"] or "").encode()) for r in rows], columns=names)
    passed = ((stats.n_words >= quality.MIN_WORDS) & (stats.n_repeat_words * 100 <= stats.n_words * quality.MAX_REPEAT_PERCENT)).tolist()
    good = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r.doc_id is not None and r.quality is not None:
            good[r.doc_id] = min(r.quality, good.get(r.doc_id, r.quality))
    marked = [i for i, r in enumerate(rows) if passed[i] and r["doc_id"] in good]
    grown = sorted((i for i in marked if good[rows[i]["doc_id"]] == 1), key=lambda i: (
        hashlib.md5(str(rows[i]["doc_id"]).encode()).hexdigest(), *stats.iloc[i]))[:quality.FIT_ROWS]
    assert len(grown) > 1
    score = quality.IsolationForest(quality.features(stats.iloc[grown])).score(quality.features(stats))
    bins = np.floor(score * quality.SCORE_BINS).astype(int)
    of = lambda kind, least: sum(bins[i] >= least for i in marked if (good[rows[i]["doc_id"]] > 0) == kind)
    best, limit = 0.0, 1.0
    for least in sorted({int(bins[i]) for i in marked}, reverse=True):
        gain = of(False, least) / max(1, of(False, -1)) - of(True, least) / max(1, of(True, -1))
        if gain > best:
            best, limit = gain, least / quality.SCORE_BINS
    assert whole(outputs["quality rules"]) == whole(r for i, r in enumerate(rows) if passed[i] and score[i] < limit)

    # near duplicates: the row of each class with the least id; texts without words all stay
    rows = inputs["n-gram Jaccard join"]
    worded = [r for r in rows if (r["text"] or "").encode().split()]
    first = {c for _, c, *_ in lsh_forest.brute_force([(r["doc_id"], r["text"]) for r in worded])[1]}
    assert whole(outputs["n-gram Jaccard join"]) == whole(r for r in rows if r not in worded or r["doc_id"] in first)

    # passages: texts less every character that a repeated window touches; gone only without a word left
    rows = inputs["suffix-array dedup"]
    want = cut_passages([(r["doc_id"], r["text"]) for r in rows])
    left = [r | {"text": want[r["doc_id"]][0], "n_chars": len(want[r["doc_id"]][0])} if want[r["doc_id"]][1] else r for r in rows]
    assert whole(outputs["suffix-array dedup"]) == whole(
        r for r in left if not want[r["doc_id"]][1] or r["text"].encode().split())

    # mix: whole copies by the SQL of operator 10
    rows = inputs["mixing sources to target weights"]
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows))
    copies = {i: n for i, n in con.execute(f"SELECT doc_id, copies FROM ({mixing.mixing_sql('given')})").fetchall()}
    assert whole(outputs["mixing sources to target weights"]) == whole(r for r in rows for _ in range(copies[r["doc_id"]]))

    # token ids of the library, of every copy
    tok = Tokenizer.from_file(str(public_tokenizers.path(corpus_pipeline.TOKENIZER)))
    ended = []
    for r in inputs["BPE encoding and decoding"]:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        n, listed, decoded = bpe_codec.digests(ids, tok.decode(ids, skip_special_tokens=False))
        ended.append((r["doc_id"], n, np.array(ids, "<u4").tobytes(), listed, decoded))
    assert sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["ids_sha256"], r["decoded_sha256"])
                  for r in outputs["BPE encoding and decoding"]) == sorted(ended)
