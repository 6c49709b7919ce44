from __future__ import annotations

import json

from pyspark.sql import functions as F

from conftest import pairs
from plumbline import schemas as S
from plumbline.operators import contract
from plumbline.sources import readers, writers

SNAPSHOT = {
    "schema": 1,
    "tool_version": "1",
    "module": "m",
    "generated": "2024-05-01T10:00:00Z",
    "git": {"head": "abc", "dirty": False},
    "runs": {"structure": "2024-05-01T10:00:00Z", "coverage": None, "mutation": None},
    "nodes": [
        {"id": "m", "kind": "module", "name": "m"},
        {"id": "m/p", "kind": "package", "name": "p", "parent": "m", "dir": "p"},
        {"id": "m/p.f", "kind": "func", "name": "f", "parent": "m/p", "file": "p/a.go", "line": 3, "end_line": 9},
    ],
    "edges": [{"from": "m/p", "to": "m/q", "kind": "imports"}],
    "metrics": {
        "m/p.f": {
            "cc": 3,
            "coverage": {"stmts": 4, "covered": 3, "percent": 75, "stale": True, "lines": {"covered": [4, 5], "uncovered": [6], "partial": []}},
            "mutation": {"killed": 1, "survived": 1, "not_covered": 0, "timed_out": 0, "score": 50, "stale": False, "mutants": [{"line": 4, "col": 2, "type": "X", "status": "LIVED", "description": "d"}]},
        },
        "m/p": {"crap_max": 4.5, "worst": "m/p.f", "grades": {"crap": 8, "mutation": None, "coverage": 6, "combined": 8}},
    },
}


def put(folder, name, data):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(data if isinstance(data, str) else json.dumps(data, indent=1))


def test_snapshots(spark, tmp_path):
    put(tmp_path / "repo=a" / "snapshot_id=1", "snapshot.json", SNAPSHOT)
    put(tmp_path / "repo=b" / "snapshot_id=007", "snapshot.json", SNAPSHOT | {"schema": 9})
    put(tmp_path / "repo=c" / "snapshot_id=1", "snapshot.json", "{not json")
    t = readers.read_snapshots(spark, str(tmp_path))
    assert pairs(t["rejected"], "repo", "snapshot_id", "reason") == [("b", "007", "schema 9 is not supported"), ("c", "1", "not a snapshot")]
    assert pairs(t["nodes"], "repo", "id", "line") == [("a", "m", None), ("a", "m/p", None), ("a", "m/p.f", 3)]
    assert pairs(t["edges"], "from", "to", "kind") == [("m/p", "m/q", "imports")]
    assert pairs(t["facts"], "id", "cc", "cognitive") == [("m/p", None, None), ("m/p.f", 3, None)]
    assert pairs(t["coverage"], "id", "percent", "stale", "reached") == [("m/p.f", 75.0, True, True)]
    assert pairs(t["line_states"], "line", "state") == [(4, "covered"), (5, "covered"), (6, "uncovered")]
    assert pairs(t["mutants"], "id", "line", "status") == [("m/p.f", 4, "LIVED")]
    assert pairs(t["rollups"], "id", "crap_max", "worst", "grade_mutation") == [("m/p", 4.5, "m/p.f", None)]
    assert t["snapshots"].first()["git_head"] == "abc"


def test_write_and_read_back(spark, tmp_path):
    put(tmp_path / "in" / "repo=a" / "snapshot_id=1", "snapshot.json", SNAPSHOT)
    put(tmp_path / "in" / "repo=b" / "snapshot_id=1", "snapshot.json", SNAPSHOT)
    t = readers.read_snapshots(spark, str(tmp_path / "in"))
    root = str(tmp_path / "out")
    writers.write_snapshot({k: t[k] for k in ["nodes", "edges", "snapshots"]}, root)
    writers.write_snapshot({k: t[k].where("repo = 'a'") for k in ["nodes", "edges", "snapshots"]}, root)
    nodes = writers.read_table(spark, root, "nodes", S.NODES)
    assert nodes.count() == 6 and writers.committed(spark, root).count() == 2
    # Rows without a manifest entry stay invisible.
    extra = t["nodes"].withColumns({"repo": F.lit("z"), "write_id": F.lit("unfinished")})
    extra.write.mode("append").partitionBy("write_id", "repo", "snapshot_id").parquet(f"{root}/nodes")
    assert writers.read_table(spark, root, "nodes", S.NODES).count() == 6
    # So does a rewrite of a committed snapshot before its manifest row.
    again = t["nodes"].where("repo = 'a'").withColumns({"id": F.lit("new"), "write_id": F.lit("half")})
    again.write.mode("append").partitionBy("write_id", "repo", "snapshot_id").parquet(f"{root}/nodes")
    assert writers.read_table(spark, root, "nodes", S.NODES).where("id = 'new'").count() == 0


def test_a_rewrite_with_an_empty_table_empties_it(spark, tmp_path):
    put(tmp_path / "in" / "repo=a" / "snapshot_id=1", "snapshot.json", SNAPSHOT)
    t = readers.read_snapshots(spark, str(tmp_path / "in"))
    root = str(tmp_path / "out")
    assert writers.read_table(spark, root, "edges", S.EDGES).count() == 0
    writers.write_snapshot({k: t[k] for k in ["nodes", "edges", "snapshots"]}, root)
    assert writers.read_table(spark, root, "edges", S.EDGES).count() > 0
    writers.write_snapshot({"nodes": t["nodes"], "edges": t["edges"].limit(0), "snapshots": t["snapshots"]}, root)
    assert writers.read_table(spark, root, "edges", S.EDGES).count() == 0
    assert writers.read_table(spark, root, "nodes", S.NODES).count() == 3


def test_broken_files_are_returned(spark, tmp_path):
    for folder in ("rep/repo=a/snapshot_id=1/dir=p", "mc/repo=a", "n/repo=a"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "x.json").write_text("no json {")
    found = {
        "mutation report": readers.read_mutation_reports(spark, str(tmp_path / "rep"))[1],
        "mutation cache": readers.read_mutation_caches(spark, str(tmp_path / "mc"))["rejected"],
        "note file": readers.read_notes(spark, str(tmp_path / "n"))[1],
    }
    for what, rejected in found.items():
        assert pairs(rejected, "repo", "reason") == [("a", f"not a {what}")]


def test_numbers_that_do_not_fit_reject_their_profile_alone(spark):
    rows = [("r", "p", "mode: set"), ("r", "p", "a.go:1.1,99999999999.2 1 1"), ("q", "p", "mode: set"), ("q", "p", "b.go:1.1,2.2 1 99999999999")]
    blocks, rejected = readers.parse_profile_lines(spark.createDataFrame(rows, "repo string, path string, value string"))
    assert pairs(rejected, "repo", "reason") == [("r", "not a number")]
    assert pairs(blocks, "repo", "file", "count") == [("q", "b.go", 99999999999)]
    patch = "+++ b/x.go\n@@ -1 +99999999999,2 @@\n@@ -1 +3,2 @@\n"
    hunks, bad = readers.parse_patches(spark.createDataFrame([("r", patch)], "repo string, value string"))
    assert pairs(bad, "repo", "file", "value", "reason") == [("r", "x.go", "@@ -1 +99999999999,2 @@", "not a number")]
    assert pairs(hunks, "file", "start", "end") == [("x.go", 3, 4)]


def test_commit_ids_are_the_same_in_every_read(spark, tmp_path):
    (tmp_path / "repo=a").mkdir()
    (tmp_path / "repo=a" / "log").write_text("\0commit\nx.go\n\0commit\nx.go\ny.go\n\0commit\nx.go\n")
    first, second = (pairs(readers.read_commit_logs(spark, str(tmp_path)), "commit", "file") for _ in range(2))
    assert first == second and len({c for c, _ in first}) == 3 and len(first) == 4


def test_mutation_files(spark, tmp_path):
    report = {"go_module": "m", "files": [{"file_name": "a.go", "mutations": [{"type": "X", "status": "LIVED", "line": 3, "column": 4}]}, {"file_name": "../q/./b.go", "mutations": []}]}
    put(tmp_path / "rep" / "repo=a" / "snapshot_id=1" / "dir=internal__p", "r.json", report)
    got, _ = readers.read_mutation_reports(spark, str(tmp_path / "rep"))
    assert pairs(got, "repo", "file", "line", "col", "status") == [("a", "internal/p/a.go", 3, 4, "LIVED")]
    entry = {"body_hash": "h", "engine": "g", "engine_version": "1", "ran_at": "2024-01-01T00:00:00Z", "counts": {"killed": 2, "survived": 1, "not_covered": 0, "timed_out": 0}, "mutants": [{"line_offset": 2, "col": 1, "type": "X", "status": "LIVED", "description": "d"}]}
    cache = {"schema": 1, "package": "m/p", "engine": "g", "engine_version": "1", "ran_at": "2024-01-02T00:00:00Z", "functions": {"m/p.f": entry}}
    put(tmp_path / "mc" / "repo=a", "m__p.json", cache)
    put(tmp_path / "mc" / "repo=a", "m__q.json", {**cache, "package": "m/q", "functions": {}, "error": "preflight"})
    put(tmp_path / "mc" / "repo=a", "m__r.json", {**cache, "package": "m/r", "schema": 2})
    t = readers.read_mutation_caches(spark, str(tmp_path / "mc"))
    assert pairs(t["results"], "id", "killed") == [("m/p.f", 2)]
    assert pairs(t["mutants"], "id", "line_offset") == [("m/p.f", 2)]
    assert pairs(t["runs"], "package", "error") == [("m/p", None), ("m/q", "preflight")]


def test_coverage_cache_notes_logs_sources(spark, tmp_path):
    cov = {"schema": 1, "ran_at": "2024-01-01T00:00:00Z", "functions": {"m/p.f": {"body_hash": "h", "ran_at": "2024-01-01T00:00:00Z", "stmts": 3, "covered": 2, "covered_offsets": [1], "uncovered_offsets": [2], "partial_offsets": []}}, "package_errors": {"m/q": "failed"}}
    put(tmp_path / "cc" / "repo=a", "coverage.json", cov)
    put(tmp_path / "cc" / "repo=b", "coverage.json", cov | {"schema": 3})
    t = readers.read_coverage_caches(spark, str(tmp_path / "cc"))
    assert pairs(t["results"], "repo", "id", "stmts") == [("a", "m/p.f", 3)]
    assert pairs(t["lines"], "line_offset", "state") == [(1, "covered"), (2, "uncovered")]
    assert pairs(t["errors"], "package", "error") == [("m/q", "failed")]
    put(tmp_path / "n" / "repo=a", "notes.json", [{"id": "n1", "target": "m/p.f", "line_offset": 2, "line_text": "x", "author": "user", "text": "t", "created": "2024-01-01T00:00:00Z", "resolved": False}])
    assert pairs(readers.read_notes(spark, str(tmp_path / "n"))[0], "repo", "id", "line_offset") == [("a", "n1", 2)]
    put(tmp_path / "t" / "repo=a" / "snapshot_id=1", "t.log", "ok  \tm/p\t0.1s\nFAIL\tm/q\t0.4s\nFAIL\nFAIL\tm/r [build failed]\nFAIL\tm/q\t0.4s\n")
    assert pairs(readers.read_test_logs(spark, str(tmp_path / "t")), "package") == [("m/q",), ("m/r",)]
    put(tmp_path / "src" / "repo=a" / "snapshot_id=1" / "p", "a.go", "package p\n\nfunc f() {\n}\n")
    lines = readers.read_source_lines(spark, str(tmp_path / "src"))
    got = readers.line_range(lines, "p/a.go", 3, 4)
    assert pairs(got, "n", "text") == [(3, "func f() {"), (4, "}")]


def test_edit_events(spark):
    docs = [
        {"cwd": "/w", "tool_input": {"file_path": "a.go"}},
        {"tool_input": {"edits": [{"file_path": "b.go"}, {"file_path": "b_test.go"}, {"file_path": "b.go"}]}},
        {"tool_input": {"file_path": "x.md"}},
        {},
    ]
    d = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)], "i int, value string")
    assert pairs(readers.parse_edit_events(d), "i", "file") == [(0, "a.go"), (1, "b.go")]


def test_external_graph(spark, tmp_path):
    good = {"nodes": [{"id": "py:app", "kind": "package", "name": "app", "dir": "app"}, {"id": "py:app.run", "kind": "func", "name": "run", "parent": "py:app", "file": "app/run.py", "line": 3, "end_line": 21}, {"id": "py:app.calm", "kind": "func", "name": "calm", "parent": "py:app", "file": "app/run.py", "line": 30, "end_line": 31, "pure": True}]}
    bad = {
        "nodes": [
            {"id": "ts:a", "kind": "klass", "name": "a"},
            {"id": "ts:a", "kind": "package", "name": "", "nmae": "x"},
            {"id": "ts:f", "kind": "func", "name": "f", "parent": "ts:none", "file": "/abs.ts", "line": 0, "end_line": -1},
            {"id": "m/p", "kind": "package", "name": "p"},
        ],
        "edges": [{"from": "ts:a", "to": "ts:zz", "kind": "uses"}],
        "metrics": {"ts:a": {"cc": 0, "coverage": {"stmts": 1, "covered": 2, "percent": 120}, "mutation": {"score": -1}, "extra": 1}, "ts:q": {"cc": 1}},
    }
    for name, doc in [("py", good), ("ts", bad), ("rb", "oops"), ("js", {"edges": []})]:
        put(tmp_path / "repo=a" / "snapshot_id=1" / f"source={name}", "g.json", doc)
    g = readers.read_external_graphs(spark, str(tmp_path))
    existing = spark.createDataFrame([("a", "1", "m", "module"), ("a", "1", "m/p", "package")], "repo string, snapshot_id string, id string, kind string")
    found = contract.problems(g["nodes"], g["edges"], g["metrics"], existing)
    assert pairs(found, "source", "path", "message") == sorted(
        [
            ("ts", "$.nodes[0].kind", "unknown kind"),
            ("ts", "$.nodes[1]", "unknown field"),
            ("ts", "$.nodes[1].id", "not unique"),
            ("ts", "$.nodes[1].name", "required"),
            ("ts", "$.nodes[2].file", "must be relative to the root"),
            ("ts", "$.nodes[2].line", "must be at least 1"),
            ("ts", "$.nodes[2].end_line", "must not be before line"),
            ("ts", "$.nodes[2].parent", "no such node"),
            ("ts", "$.nodes[3].id", "already used by another graph"),
            ("ts", "$.edges[0].kind", "unknown kind"),
            ("ts", "$.edges[0].to", "no such node"),
            ("ts", '$.metrics["ts:a"]', "unknown field"),
            ("ts", '$.metrics["ts:a"].cc', "must be at least 1"),
            ("ts", '$.metrics["ts:a"].coverage.covered', "must not exceed stmts"),
            ("ts", '$.metrics["ts:a"].coverage.percent', "must be within 0 and 100"),
            ("ts", '$.metrics["ts:a"].mutation.score', "must be within 0 and 100"),
            ("ts", '$.metrics["ts:q"]', "no such node"),
        ],
        key=repr,
    )
    failed = contract.failed_sources(found, g["unreadable"])
    assert pairs(failed, "source", "problems") == [("js", 0), ("rb", 0), ("ts", 17)]
    modules = existing.where("kind = 'module'")
    assert contract.not_measured_packages(failed, modules).count() == 3
    merged = contract.merged_nodes(g["nodes"], failed, modules)
    assert pairs(merged, "id", "parent", "pure") == [("py:app", "m", None), ("py:app.calm", "py:app", True), ("py:app.run", "py:app", False)]
    assert merged.where("id = 'py:app.run'").first()["effects"] == ["purity not known (from provider py)"]
