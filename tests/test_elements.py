from __future__ import annotations

import json

import pytest

from conftest import pairs
from plumbline.sources import elements, readers

NASTY = ['{', '}', '"', '\\', '\\"{', '[{"id":"x"}]', '],"edges":[{', "", "é{😀}", '\\\\"}', "a" * 300 + "{" * 40, "\n{\t}"]


def snapshot(n: int, order: list[str]) -> dict:
    nodes = [
        {
            "id": f"m/p.f{i}{NASTY[i % len(NASTY)]}",
            "kind": "func",
            "name": NASTY[(i * 5) % len(NASTY)],
            "effects": [NASTY[i % len(NASTY)], NASTY[(i + 3) % len(NASTY)]],
            "line": i,
            "end_line": i + 2,
        }
        for i in range(n)
    ]
    mutants = [{"line": 4, "col": 2, "type": "{", "status": "LIVED"}, {"line": 5, "col": 1, "type": "}]", "status": "KILLED"}]
    doc = {
        "schema": 1,
        "tool_version": 'v"{1}',
        "module": "m}",
        "git": {"head": "{abc", "dirty": True},
        "runs": {"structure": "2026-01-02T03:04:05Z"},
        "nodes": nodes,
        "edges": [{"from": a["id"], "to": b["id"], "kind": "calls"} for a, b in zip(nodes, nodes[1:])],
        "metrics": {
            a["id"]: {"cc": i, "coverage": {"stmts": 3, "covered": 1, "percent": 33.3, "lines": {"covered": [i], "uncovered": [i + 1, i + 2]}}, "mutation": {"killed": 1, "survived": 1, "mutants": mutants}}
            for i, a in enumerate(nodes)
        },
    }
    return {k: doc[k] for k in order}


LISTS = ["nodes", "edges", "metrics"]
HEAD = ["schema", "tool_version", "module", "git", "runs"]
ORDERS = [HEAD + LISTS, ["metrics", "git", "edges", "module", "nodes", "runs", "schema", "tool_version"], LISTS + HEAD]


def put(root, name, text):
    folder = root / "repo=r" / f"snapshot_id={name}"
    folder.mkdir(parents=True)
    (folder / "snapshot.json").write_text(text)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("documents")
    for i, order in enumerate(ORDERS):
        for indent, ascii_only in ((None, True), (2, False)):
            put(root, f"s{i}{indent}", json.dumps(snapshot(30, order), indent=indent, ensure_ascii=ascii_only))
    put(root, "short", json.dumps({"schema": 1, "nodes": [], "edges": [], "metrics": {}}))
    put(root, "one", json.dumps(snapshot(1, ORDERS[0]), separators=(",", ":")))
    put(root, "none", '{"schema": 1}')
    put(root, "old", json.dumps(snapshot(3, ORDERS[0]) | {"schema": 7}))
    put(root, "word", "oops")
    put(root, "cut", json.dumps(snapshot(5, ORDERS[0]))[:-40])
    return root


@pytest.mark.parametrize("split", ["64m", "2000b"])
def test_tables_equal_those_of_whole_documents(spark, folder, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    whole = readers.read_snapshots(spark, str(folder))
    expected = {k: pairs(df.select([c for c in df.columns if c != "path"]), "*") for k, df in whole.items()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        found = readers.read_snapshots(spark, str(folder), in_splits=True)
        for name, rows in expected.items():
            assert found[name].columns == whole[name].columns
            assert pairs(found[name].select([c for c in found[name].columns if c != "path"]), "*") == rows, name
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r[1] for r in expected["rejected"]} == {"old", "word", "cut"}
    assert len(expected["nodes"]) == 6 * 30 + 1


def test_what_stands_between_elements_is_checked(spark, tmp_path):
    for name, text in {
        "comma": '{"schema":1,"nodes":[{"id":"a"} {"id":"b"}]}',
        "mixed": '{"schema":1,"nodes":[{"id":"a"},3,{"id":"b"}]}',
        "first": '{"schema":1,"edges":[{"from":"a"}],"nodes":[null,{"id":"b"}]}',
        "type": '{"schema":1,"nodes":[{"id":"a","line":"x"}]}',
        "shape": '{"schema":1,"nodes":{"x":{"id":"a"}}}',
        "good": ' {"schema" : 1 , "nodes" : [ {"id":"a"} , {"id":"b"} ] , "more" : [ "{" , "}" ] , "edges" : [ ] } ',
    }.items():
        put(tmp_path, name, text)
    out = readers.read_snapshots(spark, str(tmp_path), in_splits=True)
    assert pairs(out["rejected"], "snapshot_id", "reason") == [(n, "not a snapshot") for n in ("comma", "first", "mixed", "shape", "type")]
    assert pairs(out["nodes"], "snapshot_id", "id") == [("good", "a"), ("good", "b")]


def test_elements_keep_their_text_and_order(spark, tmp_path):
    doc = {"list": [{"a": [1, {"b": "}"}]}, {}, {"a": {}}], "map": {"k\\\"{": {"v": 1}, "": {}}, "last": 3}
    put(tmp_path, "x", json.dumps(doc))
    heads, rows = elements.read_elements(spark, str(tmp_path), ["repo", "snapshot_id"])
    found = [(r["section"], r["name"], json.loads(r["value"])) for r in rows.orderBy("pos").collect()]
    assert found == [("list", None, x) for x in doc["list"]] + [("map", k, x) for k, x in doc["map"].items()]
    (head,) = heads.collect()
    assert json.loads(head["value"]) == {"list": [None], "map": {'k\\"{': None}, "last": 3} and not head["torn"]
