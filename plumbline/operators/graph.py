"""Structure of directed graphs, for many repositories at once.

Edges are ``repo, snapshot_id, from, to``. Nodes are numbered by a hash of
repository, snapshot and name; an algorithm is a state per node (number) that
moves along the edges of all repositories at once. A step is one join with the
edges, which do not move, and one shuffle of the state: a node sends to itself
over a loop what it keeps. Several steps make one job, whose result is written
to the shared folder; what is finished leaves the state and the edges there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.folding import fold, unfold_cyclic, unfold_ranks
from plumbline.schemas import SNAP
from plumbline.session import Rounds, joined_by_some_keys, settle

EDGE = SNAP + ["from", "to"]
NODE = SNAP + ["node"]


def _arrows(edges: DataFrame) -> DataFrame:
    return edges.select(*EDGE).distinct()


def _as(edges: DataFrame, end: str) -> DataFrame:
    return edges.select(*SNAP, F.col(end).alias("node"))


def related(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Undirected neighbours: ``…, node, neighbour``, optionally of some
    nodes (``…, id``)."""
    both = edges.select(*SNAP, F.col("from").alias("node"), F.col("to").alias("neighbour")).unionByName(
        edges.select(*SNAP, F.col("to").alias("node"), F.col("from").alias("neighbour"))
    )
    if nodes is not None:
        both = both.join(nodes.select(*SNAP, F.col("id").alias("node")), NODE, "left_semi")
    return both.distinct()


# Steps that one written round makes.
STEPS = 6


def _number(end: str) -> F.Column:
    return F.xxhash64(*SNAP, F.col(f"`{end}`"))


def _numbered(edges: DataFrame) -> DataFrame:
    """Distinct arrows with the numbers ``a`` and ``b`` of their ends."""
    return _arrows(edges).withColumns({"a": _number("from"), "b": _number("to")})


def _ways(edges: DataFrame, both: bool = False, length: str = "1") -> DataFrame:
    """Where a node's state goes: ``node, next, way`` (1 or the length on, -1 back, 0 itself)."""
    on = edges.selectExpr("a as node", "b as next", f"{length} as way")
    if both:
        on = on.unionByName(edges.selectExpr("b as node", "a as next", "-1 as way"))
    ends = edges.selectExpr("a as node").unionByName(edges.selectExpr("b as node")).distinct()
    return settle(on.unionByName(ends.selectExpr("node", "node as next", "0 as way")), "ways")


def _steps(state: DataFrame, step: Callable[[DataFrame], DataFrame], label: str, times: int = STEPS) -> DataFrame:
    for _ in range(times):
        state = step(state)
    return settle(state, label)


# Edges of a repository that are kept together, about. A larger one has several homes.
HOME = 1 << 17


def _homes(arrows: DataFrame) -> DataFrame:
    """Nodes with the number of their repository and how many homes its nodes are dealt over: ``node, g, parts``."""
    repo = F.xxhash64(*SNAP).alias("g")
    ends = arrows.select(repo, F.col("a").alias("node")).unionByName(arrows.select(repo, F.col("b").alias("node"))).distinct()
    parts = arrows.groupBy(repo).agg(F.ceil(F.count(F.lit(1)) / HOME).alias("parts"))
    return settle(ends.join(parts, "g"), "homes")


def _homed_ways(edges: DataFrame, homes: DataFrame) -> DataFrame:
    """As :func:`_ways` in both directions, with the homes of both ends, which lie in one repository."""
    e = edges.join(homes.withColumnRenamed("node", "a"), "a").selectExpr(
        "a", "b", "xxhash64(g, pmod(a, parts)) as ha", "xxhash64(g, pmod(b, parts)) as hb"
    )
    on = e.selectExpr("ha as home", "a as node", "hb as next_home", "b as next", "1 as way")
    back = e.selectExpr("hb as home", "b as node", "ha as next_home", "a as next", "-1 as way")
    ways = on.unionByName(back)
    stay = ways.select("home", "node").distinct().selectExpr("home", "node", "home as next_home", "node as next", "0 as way")
    return settle(ways.unionByName(stay).repartition("home").sortWithinPartitions("home", "node"), "ways")


def _homed_step(ways: DataFrame, state: DataFrame, values: list[str]) -> DataFrame:
    """Largest values that reach a node in one step; those with an ``f`` go on, those with a ``g`` back.

    States and ways lie by home. What a home sends to a node is made one row there, before it moves,
    so a step moves about a row for a node and not one for an edge, and rows of a repository, which
    come to be alike, lie side by side.
    """
    taken = [F.max(F.expr(f"if(way {'>=' if c[0] == 'f' else '<='} 0, {c}, null)")).alias(c) for c in values]
    return (
        ways.repartition("home")
        .join(state.repartition("home"), ["home", "node"])
        .groupBy("home", "next_home", "next")
        .agg(*taken)
        .select(F.col("next_home").alias("home"), F.col("next").alias("node"), *values)
        .repartition("home")
        .groupBy("home", "node")
        .agg(*[F.max(c).alias(c) for c in values])
    )


# Labels that a node has at once. Each splits the graph elsewhere, and none costs a step more.
LABELS = 4


def _extremes(edges: DataFrame, homes: DataFrame, turn: int) -> DataFrame:
    """Per node and kind of label the largest label that reaches it (``f0``, …) and that it reaches (``g0``, …).

    Labels are numbers hashed anew for each kind and turn, so no order of names is bad.
    """
    ways = _homed_ways(edges, homes)
    kinds = range(LABELS)
    label = [F.xxhash64("node", F.lit(turn * LABELS + i)) for i in kinds]
    values = [f"{c}{i}" for c in "fg" for i in kinds]
    state = ways.where("way = 0").select("home", "node", *[(label[int(c[1:])]).alias(c) for c in values])
    total = None
    while True:
        with joined_by_some_keys(edges.sparkSession):
            state = _steps(state, lambda x: _homed_step(ways, x, values), "extremes")
        # labels only grow, so equal sums mean that nothing has changed
        now = state.agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in values]).first()
        if now == total:
            return state.drop("home")
        total = now


def _by_extremes(core: DataFrame, homes: DataFrame) -> DataFrame:
    """Edges ``a, b`` whose ends reach each other; no loops are given.

    In a turn all nodes learn the largest labels before and behind them. Where those of
    one kind are the same, the node is in one component with the label's own node; nodes
    of one component agree in all, so edges between nodes that differ in any
    are on no cycle. What is left undecided goes into the next turn.
    """
    names = [f"{c}{i}" for c in "fg" for i in range(LABELS)]
    agree = " and ".join(f"x.{c} = y.{c}" for c in names)
    cyclic = " or ".join(f"x.f{i} = x.g{i}" for i in range(LABELS))
    found, turn = [core.limit(0)], 0
    while not core.isEmpty():
        at = _extremes(core, homes, turn)
        same = settle(
            core.join(at.withColumnRenamed("node", "a").alias("x"), "a")
            .join(at.withColumnRenamed("node", "b").alias("y"), "b")
            .where(agree)
            .selectExpr("a", "b", f"({cyclic}) as cyclic"),
            "same-extremes",
        )
        found.append(same.where("cyclic").select("a", "b"))
        core, turn = _trim(same.where("not cyclic").select("a", "b")), turn + 1
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


# A graph is folded on as long as this share of its edges, at most, is left.
WORTH = 0.7


def _turned(edges: DataFrame, back: bool) -> DataFrame:
    return edges.selectExpr("b as a", "a as b") if back else edges.select("a", "b")


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """Edges whose ends reach each other, self-loops included.

    The graph is trimmed and folded along its edges and against them, as long as that makes it
    much smaller; what is left is decided by labels, and the answer is unfolded.
    """
    arrows = settle(_numbered(edges), "arrows")
    core = _trim(arrows.where("a <> b").select("a", "b"))
    size, before, levels = core.count(), None, []
    while size and (before is None or size <= WORTH * before):
        for back in (False, True):
            way = _turned(core, back)
            folded = fold(way.withColumn("w", F.lit(1)))
            levels.append((way, folded, back))
            core = _trim(_turned(folded.edges.where("a <> b"), back))
        size, before = core.count(), size
    found = _by_extremes(core, _homes(arrows))
    for way, folded, back in reversed(levels):
        found = _turned(unfold_cyclic(way, folded, _turned(found, back)), back)
    return arrows.where("a = b").unionByName(arrows.where("a <> b").join(found, ["a", "b"], "left_semi")).select(*EDGE)


def _trim(edges: DataFrame) -> DataFrame:
    """Without edges from a node that nothing reaches or to one that reaches nothing, two steps deep."""
    for _ in range(2):
        edges = edges.join(edges.selectExpr("b as a").distinct(), "a", "left_semi").join(
            edges.selectExpr("a as b").distinct(), "b", "left_semi"
        )
    return settle(edges.select("a", "b"), "core")


def acyclic(edges: DataFrame) -> DataFrame:
    """The edges that are on no cycle.

    Which edge of a cycle a depth-first walk drops depends on the walk, so
    all edges inside a cycle go; without cycles nothing but self-loops does.
    """
    arrows = _arrows(edges)
    return settle(arrows.join(cyclic_edges(edges), EDGE, "left_anti"), "acyclic")


def _peeled(dag: DataFrame) -> DataFrame:
    """Longest path to each node (``node, rank``) of numbered edges with lengths ``w``, by in-degree.

    A node sends its rank on once, when everything before it has done so. Nodes
    on or behind a cycle never come to that and have no row.
    """
    ways = _ways(dag, length="w")
    into = dag.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("open"))
    state = (
        ways.where("way = 0").select("node").join(into, "node", "left").selectExpr("node", "coalesce(open, 0L) as open", "0L as rank", "false as sent")
    )
    done: list[DataFrame] = []
    while True:
        mine = ways if not done else ways.join(state.select("node"), "node", "left_semi")
        state = _steps(
            state,
            lambda x: mine.join(x, "node")  # noqa: B023
            .where("way = 0 or (open = 0 and not sent)")
            .groupBy(F.col("next").alias("node"))
            .agg(
                F.sum(F.expr("if(way = 0, open, -1L)")).alias("open"),
                F.max(F.expr("rank + way")).alias("rank"),
                F.max(F.expr("way = 0 and open = 0")).alias("sent"),
            ),
            "peeled",
        )
        sent = state.where("sent").select("node", "rank")
        if sent.isEmpty():
            break
        done.append(sent)
        state = state.where("not sent")
    out = done[0] if done else dag.selectExpr("a as node", "0L as rank").limit(0)
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _longest(edges: DataFrame) -> DataFrame:
    """Longest path to each node (``node, rank``) of numbered edges, folded first.

    Nodes on or behind a cycle have no row.
    """
    core, levels = settle(edges.select("a", "b", F.lit(1).alias("w")), "core"), []
    size, before = core.count(), None
    while size and (before is None or size <= WORTH * before):
        folded = fold(core)
        levels.append(folded)
        core = folded.edges
        size, before = core.count(), size
    rank = _peeled(core)
    for folded in reversed(levels):
        rank = unfold_ranks(folded, rank)
    return rank


def ranks(dag: DataFrame) -> DataFrame:
    """Longest path from an entry (a node nothing points to): ``…, node, rank``.

    Edges on a cycle count for nothing, as if the caller had dropped them; a
    node left without edges is an entry.
    """
    edges = settle(_numbered(dag), "dag")
    r = _longest(edges)
    ends = settle(_as(edges, "from").unionByName(_as(edges, "to")).distinct().withColumn("_n", _number("node")), "ends")
    rank = settle(r.withColumnRenamed("node", "_n"), "ranks-found")
    if not ends.join(rank, "_n", "left_anti").isEmpty():  # a cycle: without its edges
        edges = settle(_numbered(acyclic(edges)), "dag")
        rank = settle(_longest(edges).withColumnRenamed("node", "_n"), "ranks-found")
    return ends.join(rank, "_n", "left").select(*NODE, F.coalesce("rank", F.lit(0)).cast("int").alias("rank"))


def rank_groups(nodes: DataFrame, dag: DataFrame) -> DataFrame:
    """Rank of every node; nodes without edges form the group after the last."""
    r = ranks(dag)
    last = r.groupBy(*SNAP).agg((F.max("rank") + 1).alias("_last"))
    return (
        nodes.select(*SNAP, F.col("id").alias("node"))
        .distinct()
        .join(r, NODE, "left")
        .join(last, SNAP, "left")
        .select(*NODE, F.coalesce("rank", "_last", F.lit(0)).alias("rank"))
    )


def backbone(edges: DataFrame) -> DataFrame:
    """Edges without a longer path beside them; edges of cycles are kept.

    An edge a→b can only be redundant when the ranks of its ends differ by two
    or more. The sources of those alone are followed, packed by how far they
    must look; nodes send once, in the order of their ranks, and no word of
    sources goes beyond the furthest target it is asked about.
    """
    arrows = settle(_arrows(edges), "arrows")
    dag = acyclic(arrows)
    r = ranks(dag)
    ranked = settle(
        dag.join(r.select(*SNAP, F.col("node").alias("from"), F.col("rank").alias("rf")), SNAP + ["from"]).join(
            r.select(*SNAP, F.col("node").alias("to"), F.col("rank").alias("rt")), SNAP + ["to"]
        ),
        "ranked",
    )
    suspects = settle(ranked.where("rt - rf >= 2").select(*EDGE, _number("from").alias("a"), _number("to").alias("b"), "rt"), "suspects")
    # Sources of suspects, numbered by how far they have to look and packed, BITS to a word.
    tops = suspects.groupBy("a").agg(F.max("rt").alias("top"))
    source = settle(tops.orderBy("top").withColumn("_i", F.monotonically_increasing_id()), "sources").selectExpr(
        "a", "top", f"_i div {BITS} as word", f"cast(_i % {BITS} as int) as bit"
    )
    reach = source.groupBy("word").agg(F.max("top").alias("top"))
    state = source.drop("top").join(reach, "word").selectExpr(
        "a as node", "word", "top", "0 as rank", "shiftleft(1L, bit) as own", "0L as reached", "0L as beside"
    )
    ways = ranked.select(_number("from").alias("node"), _number("to").alias("next"), "rf", "rt", F.lit(1).alias("way"))
    stay = r.select(_number("node").alias("node"), _number("node").alias("next"), F.col("rank").alias("rf"), F.col("rank").alias("rt"), F.lit(0).alias("way"))
    ways = settle(ways.unionByName(stay), "ranked-ways")
    depth = suspects.agg(F.max("rt")).first()[0] or 0
    found = []
    for low in range(0, depth + 1, STEPS):
        part = ways.where(F.col("rf") >= low)
        for k in range(low, low + STEPS):
            # Nodes of rank k know all sources that reach them, and send: a source itself
            # reaches the next node directly, what reached the sender reaches it beside that.
            state = (
                part.join(state.drop("rank"), "node")
                .where(f"way = 0 or (rf = {k} and rt <= top)")
                .groupBy(F.col("next").alias("node"), "word")
                .agg(
                    F.max("top").alias("top"),
                    F.max("rt").alias("rank"),
                    F.bit_or(F.expr("if(way = 0, own, 0L)")).alias("own"),
                    F.bit_or(F.expr("if(way = 0, reached, reached | own)")).alias("reached"),
                    F.bit_or(F.expr("if(way = 0, beside, reached)")).alias("beside"),
                )
            )
        state = settle(state, "reached")
        found.append(state.where((F.col("rank") < low + STEPS) & (F.col("beside") != 0)).selectExpr("node as b", "word", "beside"))
        state = state.where(F.col("rank") >= low + STEPS)
    beside = found[0]
    for x in found[1:]:
        beside = beside.unionByName(x)
    hidden = suspects.join(source.drop("top"), "a").join(beside, ["b", "word"]).where("(beside & shiftleft(1L, bit)) <> 0")
    return arrows.join(hidden.select(*EDGE), EDGE, "left_anti")


BITS = 62


def reach_counts(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """How many nodes each source (``…, node``) reaches: ``…, node, reached``.

    Sources are numbered and packed, 62 to a word; a node holds the words of
    the sources that reach it, so a round moves words instead of pairs and
    combines them with OR before the shuffle. A source on a cycle reaches
    itself.
    """
    spark = edges.sparkSession
    arrows = settle(_arrows(edges), "arrows")
    numbered = settle(
        sources.select(*NODE).distinct().withColumn("_i", F.monotonically_increasing_id()), "sources"
    ).select(*NODE, F.expr(f"_i div {BITS}").alias("word"), (F.col("_i") % BITS).cast("int").alias("bit"))
    key = [*NODE, "word"]
    rounds = Rounds(spark, "reach")
    start = numbered.groupBy(*key).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    # The first step leaves the sources, so that a source itself only counts
    # when a path comes back to it.
    front = start
    first = True
    while first or not front.isEmpty():
        offer = (
            arrows.join(front.withColumnRenamed("node", "from"), SNAP + ["from"])
            .groupBy(*SNAP, F.col("to").alias("node"), "word")
            .agg(F.bit_or("bits").alias("bits"))
        )
        if not first:
            known = rounds.all().groupBy(*key).agg(F.bit_or("bits").alias("_known"))
            offer = offer.join(known, key, "left").select(
                *key, F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_known", F.lit(0).cast("long")))).alias("bits")
            )
        first = False
        front = rounds.add(offer.where("bits <> 0"))
    counted = (
        rounds.all()
        .select(*SNAP, "word", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit"), "bits")
        .where(F.expr("(bits & shiftleft(1L, bit)) <> 0"))
        .groupBy(*SNAP, "word", "bit")
        .agg(F.count("*").alias("reached"))
    )
    return numbered.join(counted, SNAP + ["word", "bit"], "left").select(
        *NODE, F.coalesce("reached", F.lit(0)).alias("reached")
    )


def primary_entry(edges: DataFrame) -> DataFrame:
    """Per snapshot, the entry that reaches most nodes (lowest id on ties)."""
    dag = acyclic(edges)
    entries = _as(dag, "from").distinct().join(_as(dag, "to").distinct(), NODE, "left_anti")
    reach = reach_counts(edges, entries)
    best = F.min(F.struct((-F.col("reached")).alias("r"), F.col("node")))
    return (
        reach.groupBy(*SNAP)
        .agg(best.alias("_b"))
        .select(*SNAP, F.col("_b.node").alias("entry"), (-F.col("_b.r")).alias("reached"))
    )


