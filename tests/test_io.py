"""Readers/writers: JSON array with mixed file forms, load guard, report tables."""

import json
import os

import pytest

from sievekit.sources import io as IO
from sievekit.plans import dedup_stage as DS
from sievekit.plans.report import dedup_summary


def test_json_array_mixed_files_and_guard(spark, tmp_path):
    p = tmp_path / "designs.json"
    body = " ".join(f"w{i}" for i in range(30))
    p.write_text(json.dumps([
        {"algo_name": "a", "source_name": "s1", "source_code": [{"file_name": "k.cpp", "file_content": body}]},
        {"algo_name": "b", "source_name": "s1", "source_code": [body]},
        {"algo_name": "c", "source_code": []},
    ]))
    df = IO.read_design_array(spark, str(p))
    rows = {r["design_idx"]: r for r in df.collect()}
    assert rows[0]["files"][0]["file_name"] == "k.cpp"
    assert rows[1]["files"][0]["file_name"] is None and rows[1]["files"][0]["file_content"] == body
    assert rows[2]["files"] == [] and rows[2]["source_name"] is None
    res = DS.deduplicate(df, similarity_threshold=0.8)
    assert {r[0] for r in res.kept.collect()} == {0}
    text = dedup_summary(res, 0.8)
    assert "duplicates: 1" in text and "| 1 | 0 | 1.000 |" in text
    out = str(tmp_path / "report")
    IO.write_dedup_report(spark, out, {"similarity_threshold": 0.8}, res, df)
    assert sorted(os.listdir(out)) == ["duplicates", "kept", "metrics", "params"]
    empty = tmp_path / "empty.json"
    empty.write_text("[]")
    with pytest.raises(IO.EmptyInput):
        IO.read_design_array(spark, str(empty))


def test_json_lines_round_trip_and_csv(spark, tmp_path):
    from sievekit.sources import tables as TB
    from helpers import SF001
    code = TB.code_corpus(spark, SF001).where("design_idx < 30")
    out = str(tmp_path / "designs")
    IO.write_designs(code, out, fmt="json")
    back = IO.read_design_lines(spark, out)
    assert back.count() == 30
    assert {r["design_idx"] for r in back.collect()} == {r["design_idx"] for r in code.collect()}
    csv_out = str(tmp_path / "names")
    IO.write_name_source_csv(code, csv_out)
    sel = IO.read_curation_csv(spark, csv_out)
    assert sel.count() == 30 and sel.columns == ["algo_name", "source_name"]


def test_array_of_bad_rows_extra_keys_and_two_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    body = " ".join(f"w{i}" for i in range(30))
    (tmp_path / "in" / "a.json").write_text(json.dumps([
        {"algo_name": "a", "source_name": "s", "source_code": [body], "stars": 3, "design_idx": "mine"},
        {"algo_name": "b", "source_name": "s", "source_code": "no list"},
        {"algo_name": "c", "source_code": None}]))
    (tmp_path / "in" / "b.json").write_text(json.dumps([{"algo_name": "d", "source_code": [], "license": {"id": "MIT"}}]))
    designs, rejects = IO.read_designs_and_rejects(spark, str(tmp_path / "in"))
    assert {(r.design_idx, r.algo_name) for r in designs.collect()} == {(0, "a"), (2, "c"), (3, "d")}
    assert [(r.design_idx, r.reason) for r in rejects.collect()] == [(1, "source_code is no list")]
    extra = {r.design_idx: (r.stars, r.input_design_idx, r.license) for r in designs.selectExpr(
        "design_idx", "to_json(stars) stars", "to_json(input_design_idx) input_design_idx", "to_json(license) license").collect()}
    assert extra[0] == ("3", '"mine"', None) and extra[3][2] == '{"id":"MIT"}'


def test_array_larger_than_one_value_may_be(spark, tmp_path):
    """An array file of over 128 MiB keeps all its designs."""
    body = "x" * 1_000_000
    with open(tmp_path / "big.json", "w") as f:
        f.write("[")
        for i in range(140):
            f.write(("," if i else "") + json.dumps({"algo_name": f"n{i}", "source_code": [body]}))
        f.write("]")
    got = IO.read_design_array(spark, str(tmp_path / "big.json"))
    assert got.selectExpr("count(*)", "min(design_idx)", "max(design_idx)", "sum(length(files[0].file_content))").first()[:] == (140, 0, 139, 140_000_000)


def test_keyed_json_and_key_fallback(spark, tmp_path):
    from sievekit.operators import curate as CU
    (tmp_path / "k.json").write_text(json.dumps({"a": {"dataset": "s1"}, "b": {"source": "", "x": 1}, "c": "text", "d": {"benchmark": "other"}}))
    keyed = IO.read_keyed_json(spark, str(tmp_path / "k.json"))
    assert {(r.key, r.source, r.is_struct) for r in keyed.collect()} == {("a", "s1", True), ("b", "", True), ("c", None, False), ("d", "other", True)}
    sel = spark.createDataFrame([(k, "s1") for k in "abcd"], "algo_name string, source_name string")
    assert {r.key for r in CU.keyed_filter(keyed, sel).collect()} == {"a", "b", "c"}
    other = spark.createDataFrame([(0, "a", None, "s1"), (1, "z", None, "s1"), (2, None, "a", "s1")], "id int, kernel_name string, design_name string, benchmark string")
    assert {r.id for r in CU.keep_listed(other, sel).collect()} == {0, 2}


def test_files_in_order(spark, tmp_path):
    rows = [((i * 37) % 500, f"t{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(5)
    for files in (1, 6, 700):
        where = str(tmp_path / f"o{files}")
        IO.write_in_order(df, where, "id", files=files)
        got = IO.read_in_order(spark, where).orderBy("position").collect()
        assert [r.position for r in got] == list(range(500)) == [r.id for r in got]
    IO.write_in_order(df.limit(0), str(tmp_path / "none"), "id")
    assert IO.read_in_order(spark, str(tmp_path / "none")).collect() == []


def test_broken_file_is_a_reject(spark, tmp_path):
    body = " ".join(f"w{i}" for i in range(30))
    (tmp_path / "a.json").write_text(json.dumps([{"algo_name": "a", "source_code": [body]}, {"algo_name": "b", "source_code": [body]}]))
    (tmp_path / "b.json").write_text('[{"algo_name": "x", "source_code": ["')
    (tmp_path / "c.json").write_text(json.dumps([{"algo_name": "c", "source_code": [body]}]))
    (tmp_path / "d.json").write_text('{"algo_name": "no array"}')
    text = '[{"algo_name": "e1", "source_code": []}, {"algo_name": nonsense}, 7, {"algo_name": "e2"},\n {"algo_name": "cut off"'
    (tmp_path / "e.json").write_text(text)
    designs, rejects = IO.read_designs_and_rejects(spark, str(tmp_path))
    assert {(r.design_idx, r.algo_name) for r in designs.collect()} == {(0, "a"), (1, "b"), (3, "c"), (4, "e1"), (7, "e2")}
    bad = {(r.design_idx, r.reason, r.path[-6:], r.offset) for r in rejects.collect()}
    assert bad == {(2, "the element is cut off", "b.json", 1), (None, "the file is no JSON array", "d.json", 0), (5, "the element is no JSON", "e.json", text.index(' {"algo_name": nonsense')),
                   (6, "the element is no object", "e.json", text.index(" 7")), (8, "the element is cut off", "e.json", text.index("\n"))}


def test_array_over_many_tasks_equals_json(spark, tmp_path):
    """Texts full of braces, brackets, quotes and backslashes, cut at any place, in several files and forms."""
    import random
    rnd = random.Random(6)
    given = []
    for name, indent in (("a", None), ("b", 2), ("c", None)):
        rows = [{"algo_name": f"{name}{i}", "source_name": rnd.choice(["s", 'q"', "\\", None]),
                 "source_code": ["".join(rnd.choice('{}[],:"\\ \n\u00e9x') for _ in range(rnd.randint(0, 120))) for _ in range(rnd.randint(0, 3))],
                 "deep": {"k": [1, [2, {"}": "]"}]]}} for i in range(25 if name != "c" else 0)]
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=name == "a") + "\n")
        given += rows
    for size in ("300", "128m"):
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            designs, rejects = IO.read_designs_and_rejects(spark, str(tmp_path))
            assert rejects.count() == 0
            got = designs.selectExpr("design_idx", "algo_name", "source_name", "files.file_content as t", "to_json(deep) as deep").orderBy("design_idx").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert [(r.algo_name, r.source_name, r.t, json.loads(r.deep)) for r in got] == [
            (g["algo_name"], g["source_name"], g["source_code"], g["deep"]) for g in given]
        assert [r.design_idx for r in got] == list(range(50))
