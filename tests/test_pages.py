from __future__ import annotations

from pyspark.sql import functions as F

from conftest import pairs
from plumbline.functions import text
from plumbline.operators import annotate, notes, scopes, search, views

KEY = "repo string, snapshot_id string, "
NODE = KEY + "id string, kind string, name string, parent string, file string, line int, end_line int, recv string"
EDGE = KEY + "from string, to string, kind string"


def nodes(spark, *rows):
    full = [("r", "s", *x, *([None] * (8 - len(x)))) for x in rows]
    return spark.createDataFrame(full, NODE)


def test_resolve(spark):
    ids = ["m/internal/pricing.applyTiered", "m/a.Close", "m/b.T.Close", "m/pricing", "pricing"]
    d = spark.createDataFrame([("r", "s", i) for i in ids], KEY + "id string")
    q = spark.createDataFrame([("r", "s", x) for x in ["applyTiered", "Close", "Tiered", "ricing.applyTiered", "", "pricing", "T.Close"]], KEY + "query string")
    got = {r["query"]: (r["status"], r["id"], r["matches"]) for r in search.resolve(d, q).collect()}
    assert got == {
        "applyTiered": ("unique", ids[0], 1),
        "Close": ("ambiguous", None, 2),
        "Tiered": ("not_found", None, 0),
        "ricing.applyTiered": ("not_found", None, 0),
        "": ("not_found", None, 0),
        "pricing": ("exact", "pricing", 1),
        "T.Close": ("unique", "m/b.T.Close", 1),
    }
    assert pairs(search.candidates(d, q).where("query = 'Close'"), "id") == [("m/a.Close",), ("m/b.T.Close",)]


def test_fuzzy(spark):
    n = nodes(spark, ("m/p", "package", "internal/pricing", "m"), ("m/p.applyTiered", "func", "applyTiered", "m/p"), ("m/q.apt", "func", "apt", "m/q"), ("m/p.T", "type", "T", "m/p"))
    got = pairs(search.fuzzy(n, ["Ap T", "", "pric", "aed", "zz"]), "query", "position", "id", "score")
    # Labels: internal/pricing, p.applytiered, q.apt.
    assert got == [("Ap T", 1, "m/q.apt", 2), ("Ap T", 2, "m/p.applyTiered", 103), ("aed", 1, "m/p.applyTiered", 108), ("pric", 1, "m/p", 9)]


def test_neighbours(spark):
    n = nodes(spark, ("m/p", "package", "p", "m"), ("m/p.T", "type", "T", "m/p"), ("m/p.T.M", "func", "T.M", "m/p", "f", 1, 2, "T"), ("m/p.f", "func", "f", "m/p"))
    e = spark.createDataFrame([("r", "s", *x) for x in [("m/p.f", "m/p.T.M", "calls"), ("m/p.f", "m/p.T.M", "calls_dynamic"), ("m/p.T", "m/q.I", "implements"), ("m/p", "ext", "imports")]], EDGE)
    got = pairs(views.neighbours(n, e), "id", "relation", "other")
    assert got.count(("m/p.f", "callees", "m/p.T.M")) == 2
    assert ("m/p.T", "methods", "m/p.T.M") in got and ("m/p.T", "implements", "m/q.I") in got and ("m/p", "imports", "ext") in got
    assert len([x for x in got if x[:2] == ("m/p", "children")]) == 3
    assert pairs(views.function_view(n, e), "id", "relation", "other") == [("m/p.T.M", "callers", "m/p.f"), ("m/p.f", "callees", "m/p.T.M")]


def test_groups(spark):
    names = [f"a/p{i}" for i in range(20)] + [f"b/c/p{i}" for i in range(8)] + ["b/c", "solo", "x/only"]
    n = nodes(spark, *[(f"m/{x}", "package", x, "m") for x in names], ("ext", "external", "e", None))
    box = {r["package"]: r["box"] for r in views.boxes(n).collect()}
    assert box["m/a/p1"] == "group:a" and box["m/b/c"] == "group:b" and box["m/solo"] == "m/solo" and box["m/x/only"] == "m/x/only"
    home = {r["package"]: r["prefix"] for r in views.home_group(n).collect()}
    assert home["m/solo"] is None and home["m/a/p3"] == "a" and home["m/b/c/p1"] == "b" and home["m/b/c"] == "b"
    e = spark.createDataFrame([("r", "s", *x, "imports") for x in [("m/a/p1", "m/a/p2"), ("m/a/p1", "m/b/c"), ("m/a/p2", "m/b/c/p1"), ("m/solo", "ext"), ("m/solo", "gone")]], EDGE)
    assert pairs(views.module_view(n, e), "from", "to", "external") == [("group:a", "group:b", False), ("m/solo", "ext", True)]
    assert pairs(views.module_view(n, e, "a"), "from", "to") == [("m/a/p1", "m/a/p2")]


def test_note_placing(spark):
    code = {9: "return x", 20: "if a {", 21: "\treturn y", 22: "}", 23: "\treturn x", 24: "}"}
    lines = spark.createDataFrame([("r", "s", "f", n - 9, code.get(n, f"l{n}"), 9) for n in range(9, 26)], KEY + "id string, offset int, text string, base int")
    ns = [("same", 0, "return x"), ("moved", 3, "return y"), ("tie", 13, "}"), ("low", 14, "}"), ("gone", 5, "zzz"), ("shrunk", 90, "zzz"), ("none", None, None)]
    d = spark.createDataFrame([("r", "s", "f", i, o, t) for i, o, t in ns], KEY + "target string, id string, line_offset int, line_text string")
    got = {r["id"]: (r["line"], r["outdated"]) for r in notes.place(d, lines).collect()}
    assert got == {"same": (9, False), "moved": (21, False), "tie": (22, False), "low": (22, False), "gone": (14, True), "shrunk": (25, True), "none": (0, False)}


def test_note_without_text_is_kept(spark):
    lines = spark.createDataFrame([("r", "s", "f", i, f"l{i}", 9) for i in range(3)], KEY + "id string, offset int, text string, base int")
    d = spark.createDataFrame([("r", "s", "f", "a", 1, None), ("r", "s", "f", "b", 1, "l1"), ("r", "s", "f", "c", 1, "l1")], KEY + "target string, id string, line_offset int, line_text string")
    assert pairs(notes.place(d, lines), "id", "line", "outdated") == [("a", 10, True), ("b", 10, False), ("c", 10, False)]


def test_annotations(spark):
    src = ["func f() {", "\tif a && b {", "\t\tx()", "", "\t\ty()", "\t}", "\treturn a >= b", "}"]
    f = nodes(spark, ("p.f", "func", "f", "p", "a.go", 3, 10)).withColumn("doc_line", F.lit(None).cast("int"))
    lines = spark.createDataFrame([("r", "s", "a.go", i + 3, t) for i, t in enumerate(src)], KEY + "file string, n int, text string")
    st = [(4, "covered"), (5, "uncovered"), (7, "uncovered"), (9, "covered")]
    states = spark.createDataFrame([("r", "s", "p.f", *x) for x in st], KEY + "id string, line int, state string")
    mts = [(9, 2, "CONDITIONALS_BOUNDARY", "LIVED", ">= → >"), (9, 1, "X", "LIVED", "X"), (4, 5, "INVERT_LOGICAL", "LIVED", "&& → ||"), (4, 6, "X", "KILLED", "X")]
    mutants = spark.createDataFrame([("r", "s", "p.f", *x) for x in mts], KEY + "id string, line int, col int, type string, status string, description string")
    placed = spark.createDataFrame([("r", "s", "p.f", "n1", 9, "user", "equal is fine", False)], KEY + "target string, id string, line long, author string, text string, outdated boolean").withColumn("created", F.current_timestamp())
    sl = annotate.stated_lines(annotate.shown_spans(f), lines, states, mutants)
    assert sl.where("n = 9").first()["survived"] == 2
    got = pairs(annotate.annotations(sl, mutants, placed), "n", "kind", "title", "detail", "why")
    assert got == sorted(
        [
            (4, "survived", "1 mutant survived", "&& → ||", "No test separates the two sides of this && / ||."),
            (5, "not_covered", "Never run by tests", "if a && b", "lines 5–7"),
            (9, "survived", "2 mutants survived", "X   ·   >= → >", "equal is fine"),
            (9, "note", "Note from you", None, "equal is fine"),
        ],
        key=repr,
    )


def test_unique_ids_and_fingerprints(spark):
    n = nodes(spark, ("p.init", "func", "init", "p", "d/b.go", 9, 9), ("p.init", "func", "init", "p", "d/a.go", 5, 6), ("p.init", "func", "init", "p", "d/a.go", 8, 9), ("p.init", "func", "init", "p", "d/b.go", 12, 13))
    assert pairs(scopes.unique_ids(n), "file", "line", "id") == [("d/a.go", 5, "p.init"), ("d/a.go", 8, "p.init#a.go"), ("d/b.go", 12, "p.init#b.go:12"), ("d/b.go", 9, "p.init#b.go")]
    src = {"a.go": "f {\n\n  x()\n// note\n}", "b.go": "f {\n  x()\n}\n", "c.go": "f {\n  y()\n}", "d.go": "f {\n}\n  x()"}
    f = nodes(spark, *[(k, "func", k, "p", k, 1, v.count("\n") + 1) for k, v in src.items()])
    lines = spark.createDataFrame([("r", "s", k, i + 1, t) for k, v in src.items() for i, t in enumerate(v.split("\n"))], KEY + "file string, n int, text string")
    h = {r["id"]: r["body_hash"] for r in scopes.fingerprints(f, lines).collect()}
    assert h["a.go"] == h["b.go"] and len(set(h.values())) == 3 and h["a.go"].startswith("sha256:")


def test_glossary(spark):
    terms = spark.createDataFrame([("not_covered", "T", "max {crap_max}", "b", "min {coverage_min} over {churn_months}")], "term string, title string, short string, body string, good string")
    q = spark.createDataFrame([("r", " Not Covered "), ("r", "not-covered"), ("r", "huh")], "repo string, query string")
    th = scopes.with_effective_thresholds(q, None)
    got = pairs(search.lookup_terms(q, terms, th), "query", "short", "good")
    assert got == [(" Not Covered ", "max 8", "min 80 over 12"), ("huh", None, None), ("not-covered", "max 8", "min 80 over 12")]


def test_range_and_number_text(spark):
    d = spark.createDataFrame([(3, 3, 70.6), (41, 44, 100.0)], "a int, b int, v double")
    assert pairs(d, text.range_text("a", "b"), text.number("v")) == [("3", "70.6"), ("41–44", "100")]
