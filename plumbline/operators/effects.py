"""Effects of functions: local ones from scanner facts, and propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import paths
from plumbline.schemas import CALLS, CALLS_DYNAMIC, FUNC, IMPLEMENTS, SNAP
from plumbline.session import Rounds, kept_by, settle

ID = SNAP + ["id"]

# Packages whose types in a signature make a function effectful.
EFFECTFUL_TYPE_PACKAGES = ["context", "io", "os", "net", "net/http", "database/sql"]
# Packages whose every call is an effect (also all below net/).
EFFECTFUL_CALL_PACKAGES = [
    "os",
    "os/exec",
    "os/signal",
    "os/user",
    "io",
    "io/ioutil",
    "io/fs",
    "math/rand",
    "math/rand/v2",
    "crypto/rand",
    "log",
    "log/slog",
    "log/syslog",
    "syscall",
    "net",
]
# Single effectful functions of otherwise pure packages.
EFFECTFUL_CALLS = [
    "time.Now",
    "time.Sleep",
    "time.Since",
    "time.Until",
    "time.After",
    "time.AfterFunc",
    "time.Tick",
    "time.NewTimer",
    "time.NewTicker",
    "fmt.Print",
    "fmt.Printf",
    "fmt.Println",
    "fmt.Fprint",
    "fmt.Fprintf",
    "fmt.Fprintln",
    "fmt.Scan",
    "fmt.Scanf",
    "fmt.Scanln",
    "fmt.Fscan",
    "fmt.Fscanf",
    "fmt.Fscanln",
]
# Concurrency facts and their reason text.
CONCURRENCY = {"go": "go statement", "send": "channel send", "receive": "channel receive", "select": "select"}


def local_effects(facts: DataFrame, written: DataFrame, sentinels: DataFrame) -> DataFrame:
    """Why each function is effectful by itself: ``…, id, ord, reason``, one
    row per distinct reason at its first place in the source.

    ``facts``: ``…, id, ord, kind, package, name, has_receiver`` with kind
    ``signature``, ``signature_channel``, ``call``, ``read_var``,
    ``write_var``, ``go``, ``send``, ``receive`` or ``select``. ``written`` and ``sentinels``: ``…, package, name`` of
    variables written anywhere, and of error variables that start as a fixed
    error. A never-written sentinel may be read without effect.
    """
    var = SNAP + ["package", "name"]
    calm = sentinels.select(*var).distinct().join(written.select(*var).distinct(), var, "left_anti")
    f = facts.join(calm.withColumn("_calm", F.lit(True)), var, "left")
    pkg, name = F.col("package"), F.col("name")
    full = F.concat_ws(".", pkg, name)
    shown = F.concat_ws(".", paths.short("package"), name)
    in_sig = pkg.isin(EFFECTFUL_TYPE_PACKAGES) | ((pkg == "log") & (name == "Logger"))
    calls = (
        pkg.isin(EFFECTFUL_CALL_PACKAGES)
        | pkg.startswith("net/")
        | (~F.coalesce("has_receiver", F.lit(False)) & full.isin(EFFECTFUL_CALLS))
    )
    kind = F.col("kind")
    reason = F.coalesce(
        F.when((kind == "signature") & in_sig, F.concat(F.lit("uses "), full)),
        F.when(kind == "signature_channel", F.lit("uses a channel")),
        F.when((kind == "call") & calls, F.concat(F.lit("calls "), full)),
        F.when(kind == "write_var", F.concat(F.lit("writes var "), shown)),
        F.when((kind == "read_var") & F.col("_calm").isNull(), F.concat(F.lit("reads var "), shown)),
        *[F.when(kind == k, F.lit(text)) for k, text in CONCURRENCY.items()],
    )
    return (
        f.withColumn("reason", reason)
        .where("reason IS NOT NULL")
        .groupBy(*ID, "reason")
        .agg(F.min("ord").alias("ord"))
        .select(*ID, "ord", "reason")
    )


def implementations(edges: DataFrame) -> DataFrame:
    """Interface methods called dynamically and the methods that implement
    them: ``…, method, implementation``. An implementation is listed even when
    it is no node of its own."""
    called = (
        edges.where(F.col("kind") == CALLS_DYNAMIC)
        .select(*SNAP, F.col("to").alias("method"))
        .distinct()
        .withColumn("iface", paths.method_owner("method"))
    )
    types = (
        edges.where(F.col("kind") == IMPLEMENTS)
        .select(*SNAP, F.col("to").alias("iface"), F.col("from").alias("type"))
        .distinct()
    )
    return called.join(types, SNAP + ["iface"]).select(
        *SNAP, "method", F.concat_ws(".", "type", paths.method_name("method")).alias("implementation")
    )


# Joins on functions are on their numbers, which sort and move faster than names do.
AT = ["node", *SNAP]


def _number(name: str) -> Column:
    """The number of a function in its repository; two numbers are the same in one repository only by a chance of n²/2⁶⁵."""
    return F.when(F.col(f"`{name}`").isNotNull(), F.xxhash64("repo", F.col(f"`{name}`")))


def _dependencies(funcs: DataFrame, markable: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Effects travel along ``(from → on)`` to whoever may get one (``markable``); callers of
    interface methods with no or an unknown implementation are effectful at once. An edge given twice is listed twice."""
    ids = funcs.select(*AT).hint("shuffle_hash")
    callers = markable.select(F.col("node").alias("a"), *SNAP).hint("shuffle_hash")
    e = (
        edges.where(F.col("kind").isin(CALLS, CALLS_DYNAMIC))
        .select(*SNAP, "from", "to", "kind", _number("from").alias("a"), _number("to").alias("node"))
        .join(callers, ["a", *SNAP], "left_semi")
    )
    cols = [*SNAP, "from", "to", "kind", "on", "a", "b"]
    direct = e.join(ids, AT, "left_semi").withColumns({"on": F.col("to"), "b": F.col("node")}).select(*cols)
    methods = implementations(edges).select(*SNAP, _number("method").alias("node"), "implementation")
    # few of all calls, and read for both results
    iface = settle(
        e.where(F.col("kind") == CALLS_DYNAMIC)
        .join(ids, AT, "left_anti")
        .join(methods, AT, "left")
        .select(*SNAP, "from", "to", "a", F.col("implementation").alias("on"), _number("implementation").alias("node")),
        "interface-calls",
    )
    known = iface.join(ids, AT, "left_semi").withColumns({"kind": F.lit("interface"), "b": F.col("node")})
    unknown = iface.join(ids, AT, "left_anti")
    return direct.unionByName(known.select(*cols)), unknown.select(*SNAP, "from", "to", F.col("a").alias("node"))


def _reason(kind: str, to: str):
    name = paths.short(to)
    return (
        F.when(F.col(kind) == CALLS, F.concat(F.lit("calls "), name, F.lit(" (effectful)")))
        .when(F.col(kind) == CALLS_DYNAMIC, F.concat(F.lit("may call "), name, F.lit(" (effectful)")))
        .otherwise(F.concat(F.lit("calls "), name, F.lit(" through an interface")))
    )


def effect_inputs(
    nodes: DataFrame, edges: DataFrame, effectful: DataFrame, allow: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What effects spread over: functions (``…, id``), dependencies (``…, from,
    to, kind, on``: whoever may get an effect, and from where) and seeds (``…,
    id, reason``: effectful whatever they call; NULL: by themselves). Functions and
    seeds have their number (``node``), dependencies those of both ends (``a, b``)."""
    flag = lambda ids, name: ids.select(_number("id").alias("node"), *SNAP, F.lit(True).alias(name)).distinct()
    names = nodes.where(F.col("kind") == FUNC).select(*ID).distinct().withColumn("node", _number("id"))
    names = names.join(flag(effectful, "_own"), AT, "left")
    names = names.withColumn("_allowed", F.lit(None).cast("boolean")) if allow is None else names.join(flag(allow, "_allowed"), AT, "left")
    names = settle(names.select(*ID, "node", "_own", "_allowed"), "function-numbers")
    funcs = names.select(*ID, "node")
    markable = names.where("_allowed is null")
    deps, unknown = _dependencies(funcs, markable, edges)
    own = markable.where("_own").select(*ID, "node", F.lit(None).cast("string").alias("reason"))
    blind = (
        unknown.groupBy(*AT)
        .agg(F.min("from").alias("id"), F.min("to").alias("to"))
        .join(own.select(*AT), AT, "left_anti")
        .select(*ID, "node", F.concat(F.lit("calls "), paths.short("to"), F.lit(" through an interface")).alias("reason"))
    )
    return funcs, deps, own.unionByName(blind)


# A function in a search: its number, and one of its repository (and snapshot).
NODE = ["node", "g"]


def _here(key: list[str]) -> Column:
    return F.xxhash64(*key).alias("g")


def _arrows(deps: DataFrame, key: list[str]) -> DataFrame:
    """Dependencies by numbers, written: ``g, a, b``, where ``a`` depends on ``b``."""
    return settle(deps.select(_here(key), "a", "b").distinct(), "arrows")


def _at(marks: DataFrame, end: str, name: str = "at") -> DataFrame:
    return marks.select(F.col("node").alias(end), "g", F.col("at").alias(name))


def _search(arrows: DataFrame, front: DataFrame, label: str) -> DataFrame:
    """Marks ``node, g, at`` of a search from ``front`` against the arrows.

    The arrows stay where they are. A round moves the last round's new marks to
    them, and what these hit; the new ones of it are written to the shared folder.
    """
    rounds, cores = Rounds(arrows.sparkSession, label), arrows.sparkSession.sparkContext.defaultParallelism
    with kept_by(arrows, "b", "g") as kept:
        front = rounds.add(front.select(*NODE, F.col("at").cast("int").alias("at")))
        while not front.isEmpty():
            hit = (
                kept.join(_at(front, "b").hint("shuffle_hash"), ["b", "g"])
                .coalesce(cores)  # few rows are hit, and each task that sends some opens a file for each partition
                .groupBy(F.col("a").alias("node"), "g")
                .agg((F.min("at") + 1).alias("at"))
            )
            front = rounds.add(hit.join(rounds.all().select(*NODE), NODE, "left_anti"))
    return rounds.all().select(*NODE, "at")


def _purity(funcs: DataFrame, deps: DataFrame, seeds: DataFrame, marks: DataFrame, key: list[str]) -> DataFrame:
    """``…, id, pure, reason, round`` of all functions. Who does not ask for reasons does not pay for them."""
    below = (
        deps.select(_here(key), "a", "b", "to", "kind")
        .join(_at(marks, "b", "below"), ["b", "g"])
        .join(_at(marks, "a"), ["a", "g"])
        .where("below < at")
        .groupBy(F.col("a").alias("node"), "g")
        .agg(F.min(F.struct("below", "to", "kind")).alias("_e"))
        .select(*NODE, _reason("_e.kind", "_e.to").alias("reason"))
    )
    reasons = below.unionByName(seeds.select("node", _here(key), "reason")).groupBy(*NODE).agg(F.min("reason").alias("reason"))
    return (
        funcs.select(*ID, "node", _here(key))
        .join(marks, NODE, "left")
        .join(reasons, NODE, "left")
        .select(*ID, F.col("at").isNull().alias("pure"), "reason", F.col("at").alias("round"))
    )


def propagate(nodes: DataFrame, edges: DataFrame, effectful: DataFrame, allow: DataFrame | None = None) -> DataFrame:
    """Purity of every function: ``…, id, pure, reason, round``.

    ``effectful``: functions with local effects; ``allow``: functions that are
    pure whatever they do. All rules ask for the existence of one effectful
    callee, so the fixed point is a search from the effectful functions
    against the direction of calls. Each round is written to the shared folder
    and only extends the last round's new functions. ``reason`` names the
    smallest edge of the round that marked a function (NULL: its own effects).
    """
    return spread(*effect_inputs(nodes, edges, effectful, allow))


def spread(funcs: DataFrame, deps: DataFrame, seeds: DataFrame) -> DataFrame:
    """As :func:`propagate`, from ``effect_inputs``."""
    start = seeds.select("node", _here(SNAP), F.lit(0).alias("at"))
    marks = _search(_arrows(deps, SNAP), start, "effects")
    return _purity(funcs, deps, seeds, marks, SNAP)


REPO = ["repo"]


def _unmark(arrows: DataFrame, marks: DataFrame, seeds: DataFrame) -> DataFrame:
    """Marks (``node, g``) without a support. A support is an arrow to a mark of a lower round, and seeds need none.

    Supports are counted once. A mark that goes takes its arrows from those that lean on it, and whoever
    has lost all goes too; what some have lost so far is carried from round to round.
    """
    supports = (
        arrows.join(_at(marks, "b", "below"), ["b", "g"])
        .join(_at(marks, "a"), ["a", "g"])
        .where("below < at")
        .select("a", "b", "g")
        .join(seeds.select(F.col("node").alias("a"), "g"), ["a", "g"], "left_anti")
    )
    supports = settle(supports, "supports")
    count = supports.groupBy("a", "g").agg(F.count(F.lit(1)).alias("had"))
    loose = (
        marks.select(*NODE)
        .join(seeds, NODE, "left_anti")
        .join(count.select(F.col("a").alias("node"), "g"), NODE, "left_anti")
        .select(*NODE, F.lit(0).cast("long").alias("lost"), F.lit(0).cast("long").alias("had"))
    )
    rounds, cores = Rounds(arrows.sparkSession, "unmarked"), arrows.sparkSession.sparkContext.defaultParallelism
    with kept_by(supports.join(count, ["a", "g"]), "b", "g") as kept:
        asked = rounds.add(loose)
        while not (gone := asked.where("lost = had")).isEmpty():
            lost = kept.join(gone.select(F.col("node").alias("b"), "g").hint("shuffle_hash"), ["b", "g"]).select(
                F.col("a").alias("node"), "g", F.lit(1).cast("long").alias("lost"), "had"
            )
            asked = rounds.add(
                lost.coalesce(cores)
                .unionByName(asked.where("lost < had"))
                .groupBy(*NODE)
                .agg(F.sum("lost").alias("lost"), F.max("had").alias("had"))
            )
    return rounds.all().where("lost = had").select(*NODE)


def repropagate(
    before: DataFrame, old: tuple[DataFrame, DataFrame], funcs: DataFrame, deps: DataFrame, seeds: DataFrame
) -> DataFrame:
    """Purity after a change, from the purity before it: as ``propagate``.

    ``before`` is the result for each repository's last snapshot, ``old`` its
    dependencies and seeds; ``funcs, deps, seeds`` are ``effect_inputs`` of the
    next snapshot of the repositories that changed. Nothing of another
    repository is read beyond its key. Delete, then derive again:

    * A mark stands while the function is a seed or depends on a marked function
      of a lower round. Where it depends on none any more, its mark goes, and those
      that lean on it have lost a support. What went is seen by what is left, so ``old`` is not read.
    * New seeds, and functions that lost their mark or had none but depend on a
      standing one, start a search as in ``propagate``.

    A change is searched only as far as it goes: each function is asked once for every
    support that it loses. ``pure`` is that of a run from scratch; ``round`` is one more than that of some
    function it depended on, not always of the nearest, and ``reason`` names the smallest
    edge to a function of the lowest round.
    """
    touched = settle(funcs.select("repo").distinct(), "changed-repositories")
    # always true; with a predicate on this side, the folders of other repositories are pruned
    here = touched.where("repo >= ''")
    here = F.broadcast(here) if touched.count() <= 100_000 else here
    arrows = _arrows(deps, REPO)
    roots = settle(seeds.select("node", _here(REPO)), "seeds")
    marks = (
        before.where(~F.col("pure"))
        .join(here, "repo", "left_semi")
        .select(_number("id").alias("node"), _here(REPO), F.col("round").alias("at"))
        .join(funcs.select("node", _here(REPO)), NODE, "left_semi")
    )
    marks = settle(marks, "marks")
    # a mark that is a seed now needs no support any more
    stand = settle(
        marks.join(_unmark(arrows, marks, roots), NODE, "left_anti")
        .join(roots.withColumn("_seed", F.lit(True)), NODE, "left")
        .select(*NODE, F.expr("if(_seed, 0, at)").alias("at")),
        "standing",
    )
    bare = settle(arrows.join(_at(stand, "a"), ["a", "g"], "left_anti"), "arrows-without-mark")
    again = (
        bare.join(_at(stand, "b"), ["b", "g"])
        .groupBy(F.col("a").alias("node"), "g")
        .agg((F.min("at") + 1).alias("at"))
        .join(roots, NODE, "left_anti")
    )
    start = roots.join(stand, NODE, "left_anti").withColumn("at", F.lit(0))
    found = _search(bare, start.unionByName(again), "marked-again")
    return _purity(funcs, deps, seeds, stand.unionByName(found), REPO)
