from __future__ import annotations

import random

from conftest import pairs
from pyspark.sql import functions as F

from plumbline.operators import effects
from plumbline.session import kept_by, settle
from test_shuffles import exchanges

KEY = "repo string, snapshot_id string, "


def purity(spark, funcs, edges, seeds, allow=()):
    nodes = spark.createDataFrame([("r", "s", f, "func") for f in funcs], KEY + "id string, kind string")
    e = spark.createDataFrame([("r", "s", *x) for x in edges], KEY + "from string, to string, kind string")
    ids = lambda xs: spark.createDataFrame([("r", "s", x) for x in xs], KEY + "id string")
    rows = effects.propagate(nodes, e, ids(seeds), ids(allow)).collect()
    return {r["id"]: (r["pure"], r["reason"]) for r in rows}


FUNCS = ["m/p.a", "m/p.b", "m/p.c", "m/p.T.M", "m/q.e"]
EDGES = [("m/p.a", "m/p.b", "calls"), ("m/p.c", "m/p.I.M", "calls_dynamic"), ("m/p.T", "m/p.I", "implements")]


def test_propagation(spark):
    got = purity(spark, FUNCS, EDGES, ["m/p.b"])
    assert {k: v[0] for k, v in got.items()} == {"m/p.a": False, "m/p.b": False, "m/p.c": True, "m/p.T.M": True, "m/q.e": True}
    assert got["m/p.a"][1] == "calls p.b (effectful)"


def test_effectful_and_missing_implementations(spark):
    got = purity(spark, FUNCS, EDGES, ["m/p.T.M"])
    assert got["m/p.c"] == (False, "calls p.I.M through an interface")
    assert not purity(spark, FUNCS, EDGES[:2], [])["m/p.c"][0]
    # A promoted method has no node: its purity is unknown.
    assert not purity(spark, [f for f in FUNCS if f != "m/p.T.M"], EDGES, [])["m/p.c"][0]


def test_allow_list_stops_propagation(spark):
    got = purity(spark, FUNCS, EDGES, ["m/p.b"], allow=["m/p.b"])
    assert got["m/p.a"][0] and got["m/p.b"][0]


def test_resolved_dynamic_calls_and_cycles(spark):
    f = ["p.x", "p.y", "p.dirty", "p.z"]
    e = [("p.x", "p.y", "calls"), ("p.y", "p.x", "calls"), ("p.y", "p.dirty", "calls_dynamic"), ("p.z", "p.z", "calls"), ("p.z", "gone", "calls")]
    got = purity(spark, f, e, ["p.dirty"])
    assert got["p.y"] == (False, "may call p.dirty (effectful)")
    assert not got["p.x"][0] and got["p.z"][0]


def test_local_effects(spark):
    rows = [
        (1, "signature", "context", "Context", None),
        (2, "signature", "log", "Logger", None),
        (3, "signature", "strings", "Builder", None),
        (4, "call", "net/url", "Parse", False),
        (5, "call", "time", "Now", False),
        (6, "call", "time", "Now", True),
        (7, "call", "time", "Unix", False),
        (8, "read_var", "io", "EOF", None),
        (9, "read_var", "m/p", "cache", None),
        (10, "write_var", "m/p", "cache", None),
        (11, "go", None, None, None),
        (12, "signature_channel", None, None, None),
        (13, "call", "time", "Now", False),
        (14, "read_var", "m/p", "ErrLoose", None),
    ]
    f = spark.createDataFrame([("r", "s", "f", *x) for x in rows], KEY + "id string, ord int, kind string, package string, name string, has_receiver boolean")
    var = KEY + "package string, name string"
    sentinels = spark.createDataFrame([("r", "s", "io", "EOF"), ("r", "s", "m/p", "ErrLoose")], var)
    written = spark.createDataFrame([("r", "s", "m/p", "ErrLoose")], var)
    got = [r["reason"] for r in effects.local_effects(f, written, sentinels).orderBy("ord").collect()]
    assert got == [
        "uses context.Context",
        "uses log.Logger",
        "calls net/url.Parse",
        "calls time.Now",
        "reads var p.cache",
        "writes var p.cache",
        "go statement",
        "uses a channel",
        "reads var p.ErrLoose",
    ]


def random_code(rng, n):
    funcs = {f"p.f{i}" for i in range(n)} | {"p.T.M"}
    names = sorted(funcs) + ["p.I.M", "gone"]
    edges = {(f"p.f{rng.randrange(n)}", rng.choice(names), rng.choice(["calls", "calls", "calls_dynamic"])) for _ in range(n)}
    return funcs, edges | {("p.T", "p.I", "implements")}, {f"p.f{rng.randrange(n)}" for _ in range(n // 12)}, {f"p.f{rng.randrange(n)}" for _ in range(3)}


def changed(rng, code, n):
    funcs, edges, seeds, allow = (set(x) for x in code)
    for part in (funcs, edges, seeds, allow):
        for x in rng.sample(sorted(part), min(len(part), rng.randint(0, 4))):
            if x != ("p.T", "p.I", "implements") or rng.random() < 0.3:
                part.discard(x)
    more, e, s, a = random_code(rng, n)
    edges |= set(rng.sample(sorted(e), min(len(e), 4)))
    seeds |= set(rng.sample(sorted(s), 1))
    return funcs | {f"p.f{rng.randrange(n + 5)}"}, edges, seeds & funcs, allow


def code_frames(spark, snapshot, codes):
    rows = lambda k, f: [(repo, snapshot, *f(x)) for repo, c in codes.items() for x in sorted(c[k])]
    nodes = spark.createDataFrame(rows(0, lambda x: (x, "func")), KEY + "id string, kind string")
    edges = spark.createDataFrame(rows(1, lambda x: x), KEY + "from string, to string, kind string")
    ids = lambda k: spark.createDataFrame(rows(k, lambda x: (x,)), KEY + "id string")
    return nodes, edges, ids(2), ids(3)


def test_incremental_purity_equals_a_run_from_scratch(spark):
    """Random inserts and deletes of functions, edges, effects and allow-list entries, step after step."""
    rng = random.Random(11)
    n = 60
    codes = {f"r{k}": random_code(rng, n) for k in range(3)}
    frames = code_frames(spark, "s0", codes)
    before = settle(effects.propagate(*frames), "t")
    old = effects.effect_inputs(*frames)[1:]
    for step in range(1, 3):
        codes = {r: changed(rng, c, n) for r, c in codes.items()}
        frames = code_frames(spark, f"s{step}", codes)
        inputs = effects.effect_inputs(*frames)
        before = settle(effects.repropagate(before, old, *inputs), "t")
        cols = ("repo", "snapshot_id", "id", "pure")
        assert pairs(before, *cols) == pairs(effects.propagate(*frames), *cols)
        lower = inputs[1].alias("d").join(before.alias("a"), [F.expr("a.repo = d.repo"), F.expr("a.id = d.from")]).join(
            before.alias("b"), [F.expr("b.repo = d.repo"), F.expr("b.id = d.on")]
        ).where("a.round > 0 and b.round < a.round").select("a.repo", "a.id").distinct()
        assert lower.count() == before.where("round > 0").count()  # every mark has a support below it
        old = inputs[1:]


def test_incremental_purity_unmarks_a_cycle(spark):
    chain = {(f"p.f{i}", f"p.f{i + 1}", "calls") for i in range(5)} | {("p.f5", "p.f3", "calls")}
    code = ({f"p.f{i}" for i in range(7)}, chain | {("p.f5", "p.f6", "calls")}, {"p.f6"}, set())
    first = code_frames(spark, "s0", {"r": code})
    before = effects.propagate(*first)
    assert before.where("pure").count() == 0
    after = code_frames(spark, "s1", {"r": (code[0], chain, {"p.f6"}, set())})
    got = effects.repropagate(before, effects.effect_inputs(*first)[1:], *effects.effect_inputs(*after))
    assert [r["id"] for r in got.where("not pure").collect()] == ["p.f6"]


def test_incremental_purity_reads_no_unchanged_repository(spark, tmp_path):
    rng = random.Random(5)
    codes = {"r0": random_code(rng, 30), "r1": random_code(rng, 30)}
    frames = code_frames(spark, "s0", codes)
    parts = {"before": effects.propagate(*frames), **dict(zip(("deps", "seeds"), effects.effect_inputs(*frames)[1:], strict=True))}
    for name, df in parts.items():
        df.write.partitionBy("repo").parquet(f"{tmp_path}/{name}")
        for f in (tmp_path / name / "repo=r1").glob("*.parquet"):
            f.write_bytes(b"not readable")
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    stored = {n: spark.read.schema(d.schema).parquet(f"{tmp_path}/{n}") for n, d in parts.items()}
    after = code_frames(spark, "s1", {"r0": changed(rng, codes["r0"], 30)})
    got = effects.repropagate(stored["before"], (stored["deps"], stored["seeds"]), *effects.effect_inputs(*after))
    assert pairs(got, "id", "pure") == pairs(effects.propagate(*after), "id", "pure")


def test_arrows_stay_where_they_are_in_a_loop(spark):
    arrows = settle(spark.range(100).selectExpr("id as a", "id % 7 as b", "1L as g"), "t")
    front = settle(spark.range(3).selectExpr("id as b", "1L as g"), "t")
    with kept_by(arrows, "b", "g") as kept:
        assert kept.count() == 100
        hit = kept.join(front.hint("shuffle_hash"), ["b", "g"])
        assert exchanges(hit) - exchanges(kept) == 1  # that of the front
        assert hit.count() == 44
    assert not kept.is_cached


def test_who_asks_for_flags_does_not_pay_for_reasons(spark):
    frames = code_frames(spark, "s0", {"r0": random_code(random.Random(3), 40)})
    got = effects.propagate(*frames)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan(got.select("id", "pure")) and "Aggregate" in plan(got)
