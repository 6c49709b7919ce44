from __future__ import annotations

import json

from conftest import pairs
from plumbline.plans import external
from plumbline.sources import readers

SNAPSHOT = {
    "schema": 1,
    "module": "m",
    "graph": {
        "nodes": [
            {"id": "m", "kind": "module", "name": "m"},
            {"id": "m/p", "kind": "package", "name": "p", "parent": "m"},
            {"id": "m/p.f", "kind": "func", "name": "f", "parent": "m/p", "file": "p/a.go", "line": 3, "end_line": 9},
        ],
        "edges": [],
        "metrics": {"m/p.f": {"cc": 3, "coverage": {"stmts": 4, "covered": 4, "percent": 100.0}}},
    },
}
GOOD = {
    "nodes": [
        {"id": "py:app", "kind": "package", "name": "app", "dir": "app"},
        {"id": "py:app.run", "kind": "func", "name": "run", "parent": "py:app", "file": "app/run.py", "line": 3, "end_line": 21, "pure": True},
        {"id": "py:app.io", "kind": "func", "name": "io", "parent": "py:app", "file": "app/run.py", "line": 30, "end_line": 31},
    ],
    "edges": [{"from": "py:app.run", "to": "py:app.io", "kind": "calls"}],
    "metrics": {"py:app.run": {"cc": 5, "coverage": {"stmts": 6, "covered": 0, "percent": 0.0}}, "py:app.io": {"cc": 1}},
}
BAD = {"nodes": [{"id": "ts:a", "kind": "klass", "name": "a"}], "metrics": {"ts:a": {"cc": 9}}}


def put(folder, name, doc):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps(doc))


def test_external_graphs_are_checked_merged_and_measured(spark, tmp_path):
    put(tmp_path / "in" / "repo=a" / "snapshot_id=1", "snapshot.json", SNAPSHOT)
    for source, doc in (("py", GOOD), ("ts", BAD), ("rb", "oops")):
        put(tmp_path / "ext" / "repo=a" / "snapshot_id=1" / f"source={source}", "g.json", doc)
    own = readers.read_snapshots(spark, str(tmp_path / "in"))
    if not own["nodes"].count():  # the stored form names the graph's lists at the top
        put(tmp_path / "in" / "repo=a" / "snapshot_id=1", "snapshot.json", {k: v for k, v in SNAPSHOT.items() if k != "graph"} | SNAPSHOT["graph"])
        own = readers.read_snapshots(spark, str(tmp_path / "in"))
    out = external.analyze_external(spark, str(tmp_path / "ext"), own)
    f = {r["id"]: r for r in out["functions"].collect()}
    assert set(f) == {"m/p.f", "py:app.run", "py:app.io"}
    assert f["py:app.run"]["crap"] == 30.0 and f["m/p.f"]["crap"] == 3.0 and f["py:app.io"]["crap"] is None
    packages = {r["package"]: r for r in out["packages"].collect()}
    assert packages["py:app"]["crap_max"] == 30.0 and {"m/p", "py:app", "provider:ts", "provider:rb"} == set(packages)
    assert pairs(out["failed"], "source", "problems") == [("rb", 0), ("ts", 1)]
    assert pairs(out["nodes"].where("kind = 'package'"), "id", "parent") == [("m/p", "m"), ("provider:rb", "m"), ("provider:ts", "m"), ("py:app", "m")]
    purity = {r["id"]: r["pure"] for r in out["purity"].collect()}
    assert purity == {"m/p.f": True, "py:app.run": False, "py:app.io": False}
