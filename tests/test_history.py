from __future__ import annotations

import random

from conftest import pairs
from plumbline.operators import history, intervals, scopes
from plumbline.sources import readers

FUNCS = "repo string, snapshot_id string, id string, file string, line int, end_line int"
HUNKS = "repo string, snapshot_id string, commit string, file string, start int, end int, deleted boolean"


def test_commit_log(spark, tmp_path):
    folder = tmp_path / "logs" / "repo=x"
    folder.mkdir(parents=True)
    (folder / "log.txt").write_text("\0commit\n\na/x.go\na/y.go\n\0commit\n\na/x.go\nmain.go\n\0commit\n\nb/z.go\n")
    files = readers.read_commit_logs(spark, str(tmp_path / "logs"))
    assert pairs(history.file_churn(files, None), "repo", "file", "churn") == [
        ("x", "a/x.go", 2), ("x", "a/y.go", 1), ("x", "b/z.go", 1), ("x", "main.go", 1)
    ]
    assert pairs(history.directory_churn(files, None), "dir", "churn") == [(".", 1), ("a", 2), ("b", 1)]


PATCH = """diff --git a/p/a.go b/p/a.go
--- a/p/a.go
+++ b/p/a.go
@@ -29 +29 @@ func f()
-x
+y
@@ -40,2 +40,0 @@
-gone
@@ -48,0 +49,3 @@
+new
--- a/old.go
+++ /dev/null
@@ -1,3 +0,0 @@
-z
"""


def test_patch_text(spark):
    d = spark.createDataFrame([("r", "s", PATCH)], "repo string, snapshot_id string, value string")
    assert pairs(readers.parse_patches(d)[0], "file", "start", "end", "deleted") == [
        ("p/a.go", 29, 29, False), ("p/a.go", 40, 40, True), ("p/a.go", 49, 51, False)
    ]


def test_log_patches(spark, tmp_path):
    folder = tmp_path / "logs" / "repo=x" / "snapshot_id=s"
    folder.mkdir(parents=True)
    (folder / "log.txt").write_text("\0commit\n\n+++ b/a.go\n@@ -20,0 +21,2 @@\n+a\n\0commit\n\n+++ b/a.go\n@@ -5 +5 @@\n+b\n")
    h, _ = readers.read_log_patches(spark, str(tmp_path / "logs"))
    assert pairs(h, "repo", "snapshot_id", "file", "start", "end") == [("x", "s", "a.go", 21, 22), ("x", "s", "a.go", 5, 5)]
    assert h.select("commit").distinct().count() == 2


def test_patches_are_read_in_splits(spark, tmp_path):
    """Headers and commits are carried over the splits of a file; bad hunks come back with their reason."""
    folder = tmp_path / "logs" / "repo=x" / "snapshot_id=007"
    folder.mkdir(parents=True)
    text, want, bad = [], [], 0
    for c in range(40):
        text.append("\0commit\n")
        text += ["@@ -1 +1 @@\n"] if c % 10 == 0 else []  # before any header of this commit
        bad += c % 10 == 0
        for f in range(3):
            text.append(f"+++ b/f{f}.go\n" if f < 2 else "+++ /dev/null\n")
            for k in range(6):
                text.append(f"@@ -1 +{c * 10 + k + 1},{k} @@ func\n+{'x' * 30}\n")
                want += [(f"f{f}.go", c * 10 + k + 1, k == 0)] if f < 2 else []
        text.append("@@ -1 oops\n")  # below a deleted file: nothing
        text.append("+++ b/g.go\n@@ -1 +1,x @@\n")
        bad += 1
    (folder / "log.txt").write_text("".join(text))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        hunks, rejected = readers.read_log_patches(spark, str(tmp_path / "logs"))
        assert pairs(hunks, "file", "start", "deleted") == sorted(want, key=repr)
        assert hunks.select("commit").distinct().count() == 40
        per = hunks.groupBy("commit").count().select("count").distinct().collect()
        assert [r["count"] for r in per] == [12]
        assert rejected.count() == bad and {r.reason for r in rejected.collect()} == {"no file header", "not a hunk"}
        diffs, _ = readers.read_diffs(spark, str(tmp_path / "logs"))
        assert diffs.where("commit is not null or snapshot_id <> '007'").count() == 0 and diffs.count() == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def touch(h, a, b):
    start, end, deleted = h
    return start >= a and start + 1 <= b if deleted else start <= b and end >= a


def test_touch_rule(spark):
    cases = [((48, 48, True), False), ((19, 19, True), False), ((20, 20, True), True), ((47, 47, True), True), ((15, 20, False), True), ((10, 19, False), False)]
    f = spark.createDataFrame([("r", "s", f"f{i}", f"{i}.go", 20, 48) for i in range(len(cases))], FUNCS)
    h = spark.createDataFrame([("r", "s", "c", f"{i}.go", *h) for i, (h, _) in enumerate(cases)], HUNKS)
    got = {r["id"] for r in intervals.touched_functions(f, h).collect()}
    assert got == {f"f{i}" for i, (_, want) in enumerate(cases) if want}


def test_churn_and_scope_match_plain_loops(spark):
    rnd = random.Random(5)
    fs, line = [], 1
    for i in range(40):
        size = rnd.choice([0, 3, 30, 400])
        fs.append((f"f{i}", "hot.go" if i % 4 else "b.go", line, line + size))
        line += size + rnd.randint(1, 5)
    hs = []
    for c in range(300):
        for _ in range(rnd.randint(1, 4)):
            s = rnd.randint(0, line)
            d = rnd.random() < 0.3
            hs.append((f"c{c}", "hot.go" if rnd.random() < 0.8 else "b.go", s, s if d else s + rnd.choice([0, 2, 200]), d))
    f = spark.createDataFrame([("r", "s", *x) for x in fs], FUNCS)
    h = spark.createDataFrame([("r", "s", *x) for x in hs], HUNKS)
    want = sorted((n, len({c for c, hf, *x in hs if hf == file and touch(x, a, b)})) for n, file, a, b in fs)
    assert pairs(intervals.commits_touching(f, h, salts=3), "id", "churn") == sorted(want, key=repr)
    few = spark.createDataFrame([("r", "s", *x) for x in hs[:15]], HUNKS)
    un = spark.createDataFrame([("r", "b.go")], "repo string, file string")
    got = {r["id"] for r in scopes.changed(f, few, un).collect()}
    assert got == {n for n, file, a, b in fs if file == "b.go" or any(hf == file and touch(x, a, b) for _, hf, *x in hs[:15])}
