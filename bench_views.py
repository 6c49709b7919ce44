"""The engine's input tables, derived from the supplied star-schema tables.

Plain arithmetic and string building only, so that ``oracle_views.py`` states
the same derivation in ANSI SQL. Every view covers its whole source table.

* a part is a function; ``p_partkey div 1000`` is its repository;
* a line item is a coverage block, a mutant, a hunk and a call of its part;
* an order is the commit of its line items;
* a document is a source file, a label a set of notes, an event a change.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.schemas import SNAP
from plumbline.session import joined_by_some_keys, settle

AS_OF = "2001-08-01 00:00:00"
REPO_SIZE = 1000
STATUS = {
    ("R", "F"): "KILLED",
    ("R", "O"): "LIVED",
    ("N", "F"): "NOT COVERED",
    ("N", "O"): "TIMED OUT",
    ("A", "F"): "NOT VIABLE",
    ("A", "O"): "SKIPPED",
}
TYPES = [
    "ARITHMETIC_BASE",
    "CONDITIONALS_BOUNDARY",
    "CONDITIONALS_NEGATION",
    "INCREMENT_DECREMENT",
    "INVERT_ASSIGNMENTS",
    "INVERT_BITWISE",
    "INVERT_BWASSIGN",
    "INVERT_LOGICAL",
    "INVERT_LOOPCTRL",
    "INVERT_NEGATIVES",
    "CUSTOM_TYPE",
]


def view(fn):
    """Build each derived table once per ``Views``."""

    @functools.wraps(fn)
    def once(self: Views) -> DataFrame:
        if fn.__name__ not in self._built:
            self._built[fn.__name__] = fn(self)
        return self._built[fn.__name__]

    return once


class Views:
    """Derived tables of one data folder; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir
        self._built: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A supplied table. One rule for all: fewer files than cores are spread
        over the cores, since a file may be a single piece to read."""
        key = f"table:{name}"
        if key not in self._built:
            df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            cores = self.spark.sparkContext.defaultParallelism
            self._built[key] = df.repartition(cores) if len(df.inputFiles()) < cores else df
        return self._built[key]

    def source(self, name: str) -> DataFrame:
        """A supplied table as its files lie, for what is shuffled by a key next."""
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def stored(self, name: str) -> DataFrame:
        """A derived table written once, as a job finds it on disk."""
        key = f"stored:{name}"
        if key not in self._built:
            self._built[key] = settle(getattr(self, name)(), name)
        return self._built[key]

    # --- structure ---------------------------------------------------------

    @view
    def part_functions(self) -> DataFrame:
        p = self.table("part")
        size = F.col("p_size").cast("int")
        k = (F.col("p_partkey") % REPO_SIZE).cast("int")
        method = F.col("p_name").startswith("red ")
        repo = F.concat(F.lit("repo"), F.expr(f"p_partkey div {REPO_SIZE}").cast("string"))
        pkg = F.concat(F.lower("p_type"), F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))
        name = F.concat(F.when(method, F.lit("T.")).otherwise(F.lit("")), F.lit("F"), k.cast("string"))
        parent = F.concat(repo, F.lit("/"), pkg)
        line = k * 60 + 3
        return p.select(
            "p_partkey",
            "p_type",
            "p_name",
            repo.alias("repo"),
            k.alias("k"),
            size.alias("size"),
            pkg.alias("pkg_name"),
            parent.alias("parent"),
            F.when(method, F.lit("T")).alias("recv"),
            name.alias("name"),
            F.concat(parent, F.lit("."), name).alias("id"),
            F.concat(pkg, F.when(size > 25, F.lit("/large.go")).otherwise(F.lit("/small.go"))).alias("file"),
            line.alias("line"),
            (line + size).alias("end_line"),
        )

    @view
    def functions(self) -> DataFrame:
        return self.part_functions().select(
            "repo",
            F.lit("s1").alias("snapshot_id"),
            "id",
            F.lit("func").alias("kind"),
            "name",
            "parent",
            F.col("pkg_name").alias("dir"),
            "file",
            "line",
            "end_line",
            F.when(F.col("size") % 2 == 0, F.col("line") - 2).cast("int").alias("doc_line"),
            (F.col("size") % 2 == 0).alias("exported"),
            "recv",
            F.concat(F.lit("h"), (F.col("size") % 4).cast("string")).alias("body_hash"),
            F.lit(None).cast("string").alias("type_kind"),
        )

    @view
    def facts(self) -> DataFrame:
        return self.part_functions().select(
            "repo",
            F.lit("s1").alias("snapshot_id"),
            "id",
            (1 + F.col("size") % 15).alias("cc"),
            ((F.col("p_partkey") * 7) % 25).cast("int").alias("cognitive"),
            (F.col("size") + 1).alias("loc"),
        )

    @view
    def nodes(self) -> DataFrame:
        """Functions, their packages, one struct and one interface type per
        package, a module per repository, and external modules."""
        f = self.functions()
        none = F.lit(None).cast("string")
        no_int = F.lit(None).cast("int")
        base = f.select("repo", "snapshot_id", "parent", "dir").distinct()
        tail = [
            none.alias("file"),
            no_int.alias("line"),
            no_int.alias("end_line"),
            no_int.alias("doc_line"),
            F.lit(None).cast("boolean").alias("exported"),
            none.alias("recv"),
            none.alias("body_hash"),
        ]
        pk = base.select(
            *SNAP,
            F.col("parent").alias("id"),
            F.lit("package").alias("kind"),
            F.col("dir").alias("name"),
            F.col("repo").alias("parent"),
            "dir",
            *tail,
            none.alias("type_kind"),
        )
        mod = base.select(*SNAP).distinct().select(
            *SNAP,
            F.col("repo").alias("id"),
            F.lit("module").alias("kind"),
            F.col("repo").alias("name"),
            none.alias("parent"),
            none.alias("dir"),
            *tail,
            none.alias("type_kind"),
        )
        types = base.withColumn("_t", F.explode(F.array(F.lit("T"), F.lit("I")))).select(
            *SNAP,
            F.concat("parent", F.lit("."), "_t").alias("id"),
            F.lit("type").alias("kind"),
            F.col("_t").alias("name"),
            "parent",
            "dir",
            F.concat("dir", F.lit("/types.go")).alias("file"),
            F.lit(1).alias("line"),
            F.lit(9).alias("end_line"),
            *tail[3:],
            F.when(F.col("_t") == "I", F.lit("interface")).otherwise(F.lit("struct")).alias("type_kind"),
        )
        ext = self.imported_modules().select(
            "repo",
            F.lit("s1").alias("snapshot_id"),
            F.col("module").alias("id"),
            F.lit("external").alias("kind"),
            F.col("ext_name").alias("name"),
            none.alias("parent"),
            none.alias("dir"),
            *tail,
            none.alias("type_kind"),
        )
        return f.unionByName(pk).unionByName(mod).unionByName(types).unionByName(ext)

    @view
    def external_modules(self) -> DataFrame:
        """A supplier's nation is an external module: ``path, module``."""
        n = self.table("nation")
        s = self.table("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        name = F.lower(F.replace("n_name", F.lit("_"), F.lit("")))
        module = F.concat(F.lit("example.org/"), name, F.lit("/v2"))
        return s.select(
            "s_suppkey",
            F.concat(module, F.lit("/s"), F.col("s_suppkey").cast("string")).alias("path"),
            module.alias("module"),
            name.alias("ext_name"),
        )

    @view
    def _lineitem_functions(self) -> DataFrame:
        p = self.part_functions().hint("shuffle_hash")
        return self.source("lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))

    @view
    def measurements(self) -> DataFrame:
        """Line items with their functions. What comes of them is read several
        times by one query, so they meet once and are written."""
        keys = ["l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"]
        return settle(
            self._lineitem_functions().select(*keys, "repo", F.lit("s1").alias("snapshot_id"), "p_type", "p_name", "size", "file", "line"),
            "measurements",
        )

    @view
    def import_paths(self) -> DataFrame:
        """A package imports the suppliers of its parts: ``importer, path``."""
        li = self._lineitem_functions().select("repo", F.col("parent").alias("importer"), "l_suppkey").distinct()
        return li.join(self.external_modules(), F.col("l_suppkey") == F.col("s_suppkey")).select(
            "repo", F.lit("s1").alias("snapshot_id"), "importer", "path", "module"
        )

    @view
    def imported_modules(self) -> DataFrame:
        """What a repository imports: ``repo, module, ext_name``. Its line items are
        made distinct suppliers before these meet their modules, and read where a
        query has already written them with their functions."""
        li = self._built.get("measurements")
        li = self._lineitem_functions() if li is None else li
        used = li.select("repo", F.col("l_suppkey").alias("s_suppkey")).distinct()
        return used.join(self.external_modules(), "s_suppkey").select("repo", "module", "ext_name").distinct()

    @view
    def raw_calls(self) -> DataFrame:
        """Function k calls function 2k + l_linenumber of its repository; with
        l_quantity 50 the call goes the other way. Half of the calls are
        dynamic; a dynamic call of a method goes through the interface."""
        p = self.part_functions()
        here = p.select(
            F.col("p_partkey").alias("l_partkey"), "repo", F.col("id").alias("_from"), F.col("k").alias("_k")
        )
        there = p.select("repo", F.col("k").alias("_to_k"), F.col("id").alias("_to"))
        li = self.source("lineitem").select("l_partkey", "l_linenumber", "l_quantity", "l_linestatus").distinct()
        c = (
            li.join(here, "l_partkey")
            .withColumn("_to_k", (F.col("_k") * 2 + F.col("l_linenumber")).cast("int"))
            .join(there, ["repo", "_to_k"])
        )
        back = F.col("l_quantity") == 50
        return c.select(
            "repo",
            F.lit("s1").alias("snapshot_id"),
            F.when(back, F.col("_to")).otherwise(F.col("_from")).alias("from"),
            F.when(back, F.col("_from")).otherwise(F.col("_to")).alias("to"),
            F.when(F.col("l_linestatus") == "F", F.lit("calls")).otherwise(F.lit("calls_dynamic")).alias("kind"),
            back.alias("back"),
        )

    @view
    def called(self) -> DataFrame:
        """The pairs of functions in ``raw_calls``, one row each, written once: ``…, from, to`` and whether
        some call is static, dynamic or forward. Line items are made distinct by numbers, and those
        that call nobody left out, before they meet functions, which they do by repository."""
        k = (F.col("l_partkey") % REPO_SIZE).cast("int")
        li = (
            self.source("lineitem")
            .select(
                F.expr(f"l_partkey div {REPO_SIZE}").alias("g"),
                k.alias("k"),
                (k * 2 + F.col("l_linenumber")).cast("int").alias("to_k"),
                (F.col("l_quantity") == 50).alias("back"),
                F.coalesce(F.col("l_linestatus") == "F", F.lit(False)).alias("static"),
            )
            .where(f"to_k < {REPO_SIZE}")
            .distinct()
        )
        p = self.part_functions().select("repo", "id", F.expr(f"p_partkey div {REPO_SIZE}").alias("g"), "k").repartition("g")
        here = p.withColumnRenamed("id", "_from").hint("shuffle_hash")
        there = p.select("g", F.col("k").alias("to_k"), F.col("id").alias("_to")).hint("shuffle_hash")
        back = F.col("back")
        with joined_by_some_keys(self.spark):
            return settle(
                li.repartition("g")
                .join(here, ["g", "k"])
                .join(there, ["g", "to_k"])
                .groupBy(
                    "g",
                    "repo",
                    F.when(back, F.col("_to")).otherwise(F.col("_from")).alias("from"),
                    F.when(back, F.col("_from")).otherwise(F.col("_to")).alias("to"),
                )
                .agg(F.bool_or("static").alias("static"), F.bool_or(~F.col("static")).alias("dynamic"), F.bool_or(~back).alias("forward"))
                .select("repo", F.lit("s1").alias("snapshot_id"), "from", "to", "static", "dynamic", "forward"),
                "called",
            )

    @view
    def calls(self) -> DataFrame:
        c = self.called()
        to = F.replace("to", F.lit(".T."), F.lit(".I.")).alias("to")
        static = c.where("static").select(*SNAP, "from", "to", F.lit("calls").alias("kind"))
        return static.unionByName(c.where("dynamic").select(*SNAP, "from", to, F.lit("calls_dynamic").alias("kind")))

    @view
    def dag(self) -> DataFrame:
        """Forward calls only: a graph without cycles."""
        return self.called().where("forward").select(*SNAP, "from", "to")

    @view
    def cyclic(self) -> DataFrame:
        return self.called().select(*SNAP, "from", "to")

    @view
    def implements(self) -> DataFrame:
        """A package with a large part has a type that implements its interface."""
        p = self.part_functions()
        return (
            p.where("size >= 40")
            .select(
                "repo",
                F.lit("s1").alias("snapshot_id"),
                F.concat("parent", F.lit(".T")).alias("from"),
                F.concat("parent", F.lit(".I")).alias("to"),
                F.lit("implements").alias("kind"),
            )
            .distinct()
        )

    @view
    def imports(self) -> DataFrame:
        """Packages import what their functions call, and external modules."""
        f = self.functions().select(*SNAP, "id", "parent")
        inner = (
            self.cyclic()
            .join(f.select(*SNAP, F.col("id").alias("from"), F.col("parent").alias("pf")), SNAP + ["from"])
            .join(f.select(*SNAP, F.col("id").alias("to"), F.col("parent").alias("pt")), SNAP + ["to"])
            .where("pf <> pt")
            .select(*SNAP, F.col("pf").alias("from"), F.col("pt").alias("to"), F.lit("imports").alias("kind"))
        )
        outer = self.import_paths().select(
            *SNAP, F.col("importer").alias("from"), F.col("module").alias("to"), F.lit("imports").alias("kind")
        )
        return inner.unionByName(outer).distinct()

    @view
    def effect_edges(self) -> DataFrame:
        """The edges that effects travel along."""
        return self.calls().unionByName(self.implements())

    @view
    def edges(self) -> DataFrame:
        return self.effect_edges().unionByName(self.imports())

    @view
    def effectful(self) -> DataFrame:
        """Largest small parts have effects of their own."""
        p = self.part_functions()
        return p.where("p_type = 'SMALL' AND size = 50").select("repo", F.lit("s1").alias("snapshot_id"), "id")

    # --- measurements ------------------------------------------------------

    @view
    def blocks(self) -> DataFrame:
        """Blocks of packages of type PROMO and of parts named ``small …`` lie in
        files that hold no function, so these parts have none."""
        q = F.col("l_quantity").cast("int")
        start = F.col("line") + q % (F.col("size") + 1)
        n = F.col("l_linenumber").cast("int")
        return (
            self.measurements()
            .select(
                "repo",
                "snapshot_id",
                F.expr("if(p_type = 'PROMO' OR startswith(p_name, 'small '), concat('unlisted/', file), file)").alias("file"),
                start.alias("start_line"),
                n.alias("start_col"),
                (start + n - 1).cast("int").alias("end_line"),
                (F.col("l_suppkey") % 3 + 1).cast("int").alias("end_col"),
                n.alias("num_stmt"),
                F.when(F.col("l_returnflag") == "R", F.col("l_suppkey") % 5).otherwise(0).cast("long").alias("count"),
            )
        )

    @view
    def file_mutants(self) -> DataFrame:
        """Mutants of packages of type LARGE lie in files that hold no function."""
        q = F.col("l_quantity").cast("int")
        status = F.coalesce(
            *[
                F.when((F.col("l_returnflag") == r) & (F.col("l_linestatus") == s), F.lit(v))
                for (r, s), v in STATUS.items()
            ]
        )
        kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("l_suppkey") % len(TYPES) + 1).cast("int"))
        return (
            self.measurements()
            .select(
                "repo",
                "snapshot_id",
                F.expr("if(p_type = 'LARGE', concat('unlisted/', file), file)").alias("file"),
                (F.col("line") + q % 60).cast("int").alias("line"),
                (F.col("l_suppkey") % 40 + 1).cast("int").alias("col"),
                kind.alias("type"),
                status.alias("status"),
            )
        )

    @view
    def mutated_functions(self) -> DataFrame:
        return self.functions().where("NOT startswith(dir, 'large/')")

    @view
    def hunks(self) -> DataFrame:
        """A line item changes ``l_linenumber − 1`` lines of its part's file
        (none: a deletion) in the commit of its order."""
        q = F.col("l_quantity").cast("int")
        start = F.col("line") + q
        n = F.col("l_linenumber").cast("int") - 1
        return self.measurements().select(
            "repo",
            "snapshot_id",
            F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("commit"),
            "file",
            start.cast("int").alias("start"),
            F.when(n == 0, start).otherwise(start + n - 1).cast("int").alias("end"),
            (n == 0).alias("deleted"),
        )

    @view
    def commit_files(self) -> DataFrame:
        o = self.source("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("timestamp").alias("ts")
        ).hint("shuffle_hash")
        return self.measurements().join(o, "l_orderkey").select(
            "repo", F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("commit"), "ts", "file"
        )

    # --- text --------------------------------------------------------------

    @view
    def documents(self) -> DataFrame:
        return self.table("documents").select(
            F.col("source").alias("repo"),
            F.lit("s1").alias("snapshot_id"),
            F.concat("lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".go")).alias("file"),
            F.col("text").alias("value"),
            "doc_id",
        )

    @view
    def source_lines(self) -> DataFrame:
        d = self.documents()
        return d.select("repo", "snapshot_id", "file", F.posexplode(F.split("value", "\n")).alias("_i", "text")).select(
            "repo", "snapshot_id", "file", (F.col("_i") + 1).cast("int").alias("n"), "text"
        )

    @view
    def text_functions(self) -> DataFrame:
        """A document is one function over all of its lines."""
        d = self.documents()
        return d.select(
            "repo",
            "snapshot_id",
            F.concat("repo", F.lit(".D"), F.col("doc_id").cast("string")).alias("id"),
            F.lit("func").alias("kind"),
            F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("name"),
            F.col("repo").alias("parent"),
            "file",
            F.lit(1).alias("line"),
            F.size(F.split("value", "\n")).alias("end_line"),
            F.lit(0).alias("doc_line"),
        )

    @view
    def text_states(self) -> DataFrame:
        """Line states of documents from the length of the line."""
        n = F.length("text") % 4
        state = (
            F.when(n == 0, F.lit("covered")).when(n == 1, F.lit("uncovered")).when(n == 2, F.lit("partial"))
        )
        return (
            self.source_lines()
            .select("repo", "snapshot_id", F.concat("repo", F.lit(".D"), F.regexp_extract("file", r"/d([0-9]+)\.go$", 1)).alias("id"), F.col("n").alias("line"), state.alias("state"))
            .where("state IS NOT NULL")
        )

    @view
    def text_notes(self) -> DataFrame:
        """Every line of a document has a note that remembers it some lines
        further down; a line of length 3 mod 4 is remembered with other text."""
        n = F.length("text")
        doc = F.regexp_extract("file", r"/d([0-9]+)\.go$", 1)
        return self.source_lines().select(
            "repo",
            "snapshot_id",
            F.concat(F.lit("n"), doc, F.lit("_"), F.col("n").cast("string")).alias("id"),
            F.concat("repo", F.lit(".D"), doc).alias("target"),
            (F.col("n") - 1 + n % 4).cast("int").alias("line_offset"),
            F.when(n % 4 == 3, F.concat(F.lit("~"), F.btrim("text"))).otherwise(F.btrim("text")).alias("line_text"),
            F.when(n % 2 == 0, F.lit("user")).otherwise(F.lit("agent")).alias("author"),
            F.concat(F.lit("note "), n.cast("string")).alias("text"),
            F.lit(None).cast("timestamp").alias("created"),
            (n % 5 == 0).alias("resolved"),
        )

    # --- events ------------------------------------------------------------

    @view
    def edit_events(self) -> DataFrame:
        e = self.table("events")
        k = F.get_json_object("props", "$.k")
        ext = F.when(F.col("event_type") == "view", F.lit(".md")).when(
            F.col("event_type") == "signup", F.lit("_test.go")
        ).otherwise(F.lit(".go"))
        return e.select(
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("repo"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.concat(F.lit("pkg/f"), k, ext).alias("file"),
            F.when(F.col("event_type") == "error", F.lit("chmod")).otherwise(F.lit("write")).alias("op"),
        )

    @view
    def activity(self) -> DataFrame:
        return self.table("events").select(
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("client"), F.col("ts").cast("timestamp").alias("ts")
        )
