"""Readers for the files that scanners, test runs and git leave behind.

Files lie below ``repo=<name>/snapshot_id=<id>/`` (caches, notes and logs:
``repo=<name>/``), so a filter on either prunes folders. Nothing is inferred:
every reader has an explicit schema, and what cannot be read is returned as
rows instead of failing the job or vanishing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from plumbline import schemas as S
from plumbline.functions import paths
from plumbline.operators import ordered
from plumbline.schemas import SNAP
from plumbline.session import settle
from plumbline.sources import elements

ID = SNAP + ["id"]


def _with_keys(schema: StructType, keys: list[str]) -> StructType:
    return StructType(list(schema.fields) + [StructField(k, StringType()) for k in keys])


VALUE = StructType([StructField("value", StringType())])
BROKEN = StructField("_broken", StringType())


def _json(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    full = _with_keys(StructType([*schema.fields, BROKEN]), keys)
    return (
        spark.read.schema(full)
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_broken")
        .option("basePath", path)
        .json(path)
        .withColumn("path", F.col("_metadata.file_path"))
    )


def _text(spark: SparkSession, path: str, keys: list[str], **options) -> DataFrame:
    return (
        spark.read.schema(_with_keys(VALUE, keys))
        .option("basePath", path)
        .text(path, **options)
        .withColumn("path", F.col("_metadata.file_path"))
    )


# --- graphs -----------------------------------------------------------------


def flatten_metrics(rows: DataFrame) -> dict[str, DataFrame]:
    """``…, id, m`` (metrics struct) as flat tables: ``facts``, ``coverage``,
    ``line_states``, ``mutation``, ``mutants``, ``given`` and ``rollups``."""
    keys = [c for c in rows.columns if c not in ("id", "m")]
    key = [*keys, "id"]
    m = F.col("m")
    cov, mut = m["coverage"], m["mutation"]
    states = F.array(
        *[F.struct(F.lit(s).alias("state"), cov["lines"][s].alias("at")) for s in ["covered", "uncovered", "partial"]]
    )
    reached = (F.coalesce(F.size(cov["lines"]["covered"]), F.lit(0)) > 0) | (
        F.coalesce(F.size(cov["lines"]["partial"]), F.lit(0)) > 0
    )
    coverage = rows.where(cov.isNotNull()).select(
        *key,
        cov["stmts"].cast("long").alias("stmts"),
        cov["covered"].cast("long").alias("covered"),
        cov["percent"].alias("percent"),
        F.coalesce(cov["stale"], F.lit(False)).alias("stale"),
        cov["lines"].isNotNull().alias("lines_known"),
        reached.alias("reached"),
    )
    line_states = (
        rows.where(cov["lines"].isNotNull())
        .select(*key, F.explode(states).alias("_s"))
        .select(*key, F.explode("_s.at").alias("line"), F.col("_s.state").alias("state"))
    )
    mutation = rows.where(mut.isNotNull()).select(
        *key,
        *[
            F.coalesce(mut[c], F.lit(0)).cast("long").alias(c)
            for c in ["killed", "survived", "not_covered", "timed_out"]
        ],
        mut["score"].alias("score"),
        F.coalesce(mut["stale"], F.lit(False)).alias("stale"),
    )
    mutants = rows.select(*key, F.explode(mut["mutants"]).alias("_m")).select(*key, "_m.*")
    grades = m["grades"]
    return {
        "facts": rows.select(*key, m["cc"].alias("cc"), m["cognitive"].alias("cognitive"), m["loc"].alias("loc")),
        "coverage": coverage,
        "line_states": line_states,
        "mutation": mutation,
        "mutants": mutants,
        "given": rows.select(*key, m["crap"].alias("crap"), m["churn"].alias("churn"), m["churn_scope"].alias("churn_scope")),
        "rollups": rows.where(m["crap_max"].isNotNull() | m["worst"].isNotNull() | m["coverage_error"].isNotNull()).select(
            *key,
            m["crap_max"].alias("crap_max"),
            m["crap_avg"].alias("crap_avg"),
            m["worst"].alias("worst"),
            grades["crap"].alias("grade_crap"),
            grades["mutation"].alias("grade_mutation"),
            grades["coverage"].alias("grade_coverage"),
            grades["combined"].alias("grade_combined"),
            m["coverage_error"].alias("coverage_error"),
            m["mutation_error"].alias("mutation_error"),
        ),
    }


def _split_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Snapshot files read in splits: what they hold beside their lists, then nodes, edges and metrics
    with the file's ``path``. A file with an element that cannot be read is broken as a whole."""
    heads, rows = elements.read_elements(spark, path, SNAP)
    rows = settle(rows, "json-elements")
    lists = {f.name: f.dataType for f in S.GRAPH_JSON.fields}
    keep = {"columnNameOfCorruptRecord": "_broken"}

    def parsed(name: str) -> DataFrame:
        shape = lists[name].valueType if name == "metrics" else lists[name].elementType
        doc = F.from_json("value", StructType([*shape.fields, BROKEN]), keep).alias("_d")
        return rows.where((F.col("section") == name) & (F.col("name").isNotNull() == F.lit(name == "metrics"))).select(*SNAP, "path", "name", doc)

    found = {name: parsed(name) for name in lists}
    misplaced = rows.where(F.col("section").isin(*lists) & ((F.col("section") == "metrics") == F.col("name").isNull()))
    unread = [d.where("_d._broken IS NOT NULL") for d in found.values()]
    bad = reduce(DataFrame.unionByName, [d.select("path") for d in [misplaced, *unread]]).distinct()
    head = StructType([*[f for f in S.SNAPSHOT_JSON.fields if f.name not in lists], BROKEN])
    raw = (
        heads.select(*SNAP, "path", "torn", "value", F.from_json("value", head, keep).alias("_d"))
        .select(*SNAP, "path", "torn", "value", "_d.*")
        .join(bad.withColumn("_bad", F.lit(True)), "path", "left")
        .withColumn("_broken", F.coalesce("_broken", F.when(F.col("torn") | F.col("_bad"), F.col("value"))))
    )
    fields = {name: [F.col(f"_d.{f}").alias(f) for f in d.schema["_d"].dataType.fieldNames() if f != "_broken"] for name, d in found.items()}
    metrics = found["metrics"].select(*SNAP, "path", F.col("name").alias("id"), F.struct(*fields["metrics"]).alias("m"))
    return raw, found["nodes"].select(*SNAP, "path", *fields["nodes"]), found["edges"].select(*SNAP, "path", *fields["edges"]), metrics


def read_snapshots(spark: SparkSession, path: str, in_splits: bool = False) -> dict[str, DataFrame]:
    """Snapshot files as tables. Files that are no JSON or of another schema
    version are in ``rejected`` with a reason.

    ``in_splits``: for files too large for one task; every file is read in
    splits and no row holds more than one node, edge or metrics entry. The tables are the same,
    but a file with a node, edge or entry of a wrong type is always rejected as a whole.
    """
    raw, *lists = _split_documents(spark, path) if in_splits else [_json(spark, path, S.SNAPSHOT_JSON, SNAP)]
    good = F.coalesce(F.col("schema") == S.SNAPSHOT_VERSION, F.lit(False)) & F.col("_broken").isNull()
    reason = F.when(F.col("_broken").isNotNull(), F.lit("not a snapshot")).otherwise(
        F.concat(F.lit("schema "), F.coalesce(F.col("schema").cast("string"), F.lit("missing")), F.lit(" is not supported"))
    )
    ok = raw.where(good)
    if in_splits:
        nodes, edges, metrics = (rows.join(ok.select("path"), "path", "left_semi").drop("path") for rows in lists)
    else:
        nodes = ok.select(*SNAP, F.explode("nodes").alias("_n")).select(*SNAP, "_n.*")
        edges = ok.select(*SNAP, F.explode("edges").alias("_e")).select(*SNAP, "_e.*")
        metrics = ok.select(*SNAP, F.explode("metrics").alias("id", "m"))
    return {
        "rejected": raw.where(~good).select(*SNAP, "path", reason.alias("reason")),
        "snapshots": ok.select(
            *SNAP,
            "schema",
            "tool_version",
            "module",
            "generated",
            F.col("git.head").alias("git_head"),
            F.col("git.dirty").alias("git_dirty"),
            F.col("runs.structure").alias("structure_at"),
            F.col("runs.coverage").alias("coverage_at"),
            F.col("runs.mutation").alias("mutation_at"),
        ),
        "nodes": nodes,
        "edges": edges,
        **flatten_metrics(metrics),
    }


_KEYS_JSON = (
    "nodes array<map<string,string>>, edges array<map<string,string>>, metrics map<string,map<string,string>>"
)


def read_external_graphs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Graphs of other languages from ``…/source=<name>/*.json``, with the
    positions and field names that validation needs. ``unreadable`` lists the
    sources that are no JSON object with nodes."""
    raw = _text(spark, path, [*SNAP, "source"], wholetext=True)
    key = [*SNAP, "source"]
    doc = raw.select(
        *key, F.from_json("value", S.GRAPH_JSON).alias("g"), F.from_json("value", _KEYS_JSON).alias("k")
    )
    ok = doc.where("k.nodes IS NOT NULL")
    nodes = (
        ok.select(*key, F.posexplode(F.arrays_zip("g.nodes", F.col("k.nodes").alias("keys"))).alias("i", "_n"))
        .select(*key, "i", F.col("_n.nodes").alias("n"), F.map_keys("_n.keys").alias("keys"))
        .select(*key, "i", "keys", "n.*")
    )
    edges = ok.select(*key, F.posexplode("g.edges").alias("i", "e")).select(*key, "i", "e.*")
    listed = ok.select(*key, F.explode("k.metrics").alias("id", "_k"), "g").select(
        *key, "id", F.map_keys("_k").alias("keys"), F.try_element_at("g.metrics", F.col("id")).alias("m")
    )
    metrics = listed.select(
        *key,
        "id",
        "keys",
        "m.cc",
        F.col("m.coverage.stmts").alias("stmts"),
        F.col("m.coverage.covered").alias("covered"),
        F.col("m.coverage.percent").alias("percent"),
        F.col("m.mutation.score").alias("score"),
    )
    return {
        "nodes": nodes,
        "edges": edges,
        "metrics": metrics,
        "metric_structs": listed.select(*key, "id", "m"),
        "unreadable": doc.where("k.nodes IS NULL").select(*key),
    }


# --- coverage and mutation --------------------------------------------------

_INT = r"^[+-]?[0-9]+$"
_MODE = "mode: "


def parse_profile_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profile text (``…, path, value``) as ``(blocks, rejected)``.

    The file name ends at the last colon; the rest must be six numbers
    between dots, commas and spaces. One malformed line, or no mode line,
    makes the whole profile unusable: its blocks are left out and ``rejected``
    says why (``…, path, value, reason``).
    """
    keys = [c for c in lines.columns if c not in ("path", "value")]
    src = [*keys, "path"]
    every = lines.select(*src, F.coalesce(paths.strip("value"), F.lit("")).alias("value"))
    t = every.where("value <> ''")
    is_mode = F.col("value").startswith(_MODE)
    tail = F.substring_index("value", ":", -1)
    fields = F.filter(F.split(tail, "[., ]"), lambda x: x != "")
    parsed = t.where(~is_mode).select(
        *src,
        "value",
        F.when(F.instr("value", ":") > 0, F.expr("left(value, length(value) - length(substring_index(value, ':', -1)) - 1)")).alias("file"),
        fields.alias("f"),
    )
    well_formed = F.col("file").isNotNull() & (F.size("f") == 6) & F.forall("f", lambda x: x.rlike(_INT))
    # digits alone may still be too many: the last number is a long, the others are ints
    fits = F.forall(F.slice("f", 1, 5), lambda x: x.try_cast("int").isNotNull()) & F.get("f", 5).try_cast("long").isNotNull()
    well_formed = well_formed & fits
    bad = parsed.where(~well_formed).select(
        *src,
        "value",
        F.when(F.col("file").isNull(), F.lit("missing ':'"))
        .when(F.size("f") != 6, F.lit("want file:l.c,l.c stmts count"))
        .otherwise(F.lit("not a number"))
        .alias("reason"),
    )
    # a profile of blank lines has none either
    no_mode = (
        every.groupBy(*src)
        .agg(F.max(is_mode).alias("moded"))
        .where("not moded")
        .select(*src, F.lit(None).cast("string").alias("value"), F.lit("no mode line").alias("reason"))
    )
    rejected = bad.unionByName(no_mode)
    names = ["start_line", "start_col", "end_line", "end_col", "num_stmt"]
    blocks = (
        parsed.where(well_formed)
        .join(rejected.select(*src).distinct(), src, "left_anti")
        .select(
            *keys,
            "file",
            *[F.get("f", i).try_cast("int").alias(n) for i, n in enumerate(names)],
            F.get("f", 5).try_cast("long").alias("count"),
        )
    )
    return blocks, rejected


def read_profiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_profile_lines(_text(spark, path, SNAP))


def _unreadable(raw: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Files that are no JSON of the kind, one row each: ``…, path, reason``."""
    # Spark does not answer queries about the broken part alone, so a field is read too.
    field = next(c for c in raw.columns if c not in (*keys, "_broken", "path"))
    read = F.coalesce(F.to_json(F.struct(field)), F.lit("")) != "-"
    return raw.where(F.col("_broken").isNotNull() & read).select(*keys, "path", F.lit(f"not a {what}").alias("reason"))


def read_mutation_reports(
    spark: SparkSession, path: str, run_dir: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(mutants, rejected)`` of engine reports, file names relative to the root.
    ``run_dir``: directory the engine ran in, as a column of the row (default:
    the ``dir=<name>`` folder with ``__`` for slashes)."""
    read = _json(spark, path, S.MUTATION_REPORT_JSON, [*SNAP, "dir"])
    raw = read.where("_broken IS NULL")
    base = run_dir if run_dir is not None else F.replace(F.coalesce("dir", F.lit(".")), F.lit("__"), F.lit("/"))
    mutants = (
        raw.withColumn("_dir", base)
        .select(*SNAP, "_dir", F.explode("files").alias("f"))
        .select(
            *SNAP,
            paths.clean_path(F.concat_ws("/", "_dir", "f.file_name")).alias("file"),
            F.explode("f.mutations").alias("m"),
        )
        .select(
            *SNAP, "file", F.col("m.line").alias("line"), F.col("m.column").alias("col"), F.col("m.type").alias("type"), F.col("m.status").alias("status")
        )
    )
    return mutants, _unreadable(read, SNAP, "mutation report")


def read_mutation_caches(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Committed mutation results: ``results``, ``mutants``, ``runs`` and the
    ``rejected`` files. Files of another schema version count as empty."""
    read = _json(spark, path, S.MUTATION_CACHE_JSON, ["repo"])
    raw = read.where((F.col("schema") == S.MUTATION_CACHE_VERSION) & F.col("_broken").isNull())
    fn = raw.select("repo", "package", F.explode("functions").alias("id", "e"))
    counts = ["killed", "survived", "not_covered", "timed_out"]
    return {
        "results": fn.select(
            "repo",
            "package",
            F.col("e.engine").alias("engine"),
            F.col("e.engine_version").alias("engine_version"),
            F.col("e.ran_at").alias("ran_at"),
            "id",
            F.col("e.body_hash").alias("body_hash"),
            *[F.coalesce(F.col(f"e.counts.{c}"), F.lit(0)).cast("long").alias(c) for c in counts],
        ),
        "mutants": fn.select("repo", "package", "id", F.explode("e.mutants").alias("m")).select(
            "repo", "package", "id", "m.*"
        ),
        "runs": raw.select("repo", "package", "ran_at", F.when(F.col("error") != "", F.col("error")).alias("error")),
        "rejected": _unreadable(read, ["repo"], "mutation cache"),
    }


def read_coverage_caches(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Coverage caches: ``results``, ``lines`` and ``errors``; another schema
    version counts as empty."""
    raw = _json(spark, path, S.COVERAGE_CACHE_JSON, ["repo"]).where(
        (F.col("schema") == S.COVERAGE_CACHE_VERSION) & F.col("_broken").isNull()
    )
    fn = raw.select("repo", F.explode("functions").alias("id", "e"))
    states = F.array(
        *[
            F.struct(F.lit(s).alias("state"), F.col(f"e.{s}_offsets").alias("at"))
            for s in ["covered", "uncovered", "partial"]
        ]
    )
    return {
        "results": fn.select(
            "repo",
            "id",
            F.col("e.body_hash").alias("body_hash"),
            F.col("e.ran_at").alias("ran_at"),
            F.col("e.stmts").cast("long").alias("stmts"),
            F.col("e.covered").cast("long").alias("covered"),
        ),
        "lines": fn.select("repo", "id", F.explode(states).alias("s")).select(
            "repo", "id", F.explode("s.at").alias("line_offset"), F.col("s.state").alias("state")
        ),
        "errors": raw.select("repo", F.explode("package_errors").alias("package", "error")),
    }


def failed_packages(lines: DataFrame) -> DataFrame:
    """Packages a test log reports as failed (``…, value``)."""
    keys = [c for c in lines.columns if c not in ("path", "value")]
    pkg = F.regexp_extract("value", r"^FAIL\t(\S+)", 1)
    return lines.select(*keys, pkg.alias("package")).where("package <> ''").distinct()


def read_test_logs(spark: SparkSession, path: str) -> DataFrame:
    return failed_packages(_text(spark, path, SNAP))


# --- history ----------------------------------------------------------------

# What git is told to print before each commit.
COMMIT_MARK = "\0commit"


def _commits(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    rows = _text(spark, path, keys, lineSep=COMMIT_MARK)
    # The log names no commits: its file, its text and a number among equal texts
    # identify one, however the file is split.
    n = rows.where(paths.strip("value") != "").groupBy(*keys, "path", "value").agg(F.count(F.lit(1)).alias("_n"))
    place = F.concat_ws(":", F.xxhash64("path").cast("string"), F.xxhash64("value").cast("string"), F.col("_i").cast("string"))
    return n.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).select(*keys, place.alias("commit"), "value")


def parse_commit_files(commits: DataFrame) -> DataFrame:
    """Name lists (``…, commit, value``) as one row per commit and file."""
    keys = [c for c in commits.columns if c != "value"]
    return (
        commits.select(*keys, F.explode(F.split("value", "\n")).alias("file"))
        .withColumn("file", paths.strip("file"))
        .where("file <> ''")
    )


def read_commit_logs(spark: SparkSession, path: str) -> DataFrame:
    """Commit logs with file names: ``repo, commit, ts, file``. The log is
    already limited to a time window, so ``ts`` is NULL."""
    return parse_commit_files(_commits(spark, path, ["repo"])).select(
        "repo", "commit", F.lit(None).cast("timestamp").alias("ts"), "file"
    )


_HUNK = r"^@@ [ \t]*[^ \t\n]+[ \t]+\+([0-9]+(?:,[0-9]+)?)(?=[ \t\r\n]|$)"


def _hunks(marked: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Hunk lines below their headers (``keys, _head, _line``) as ranges, and those that are none."""
    span = F.split(F.regexp_extract("_line", _HUNK, 1), ",")
    start = F.get(span, 0).try_cast("int")
    count = F.when(F.size(span) > 1, F.get(span, 1).try_cast("int")).otherwise(F.lit(1))
    rows = marked.where("_head IS NULL OR (_head <> '/dev/null' AND _head <> '')").select(
        *keys, F.regexp_replace("_head", "^b/", "").alias("file"), "_line", start.alias("start"), count.alias("_count")
    )
    reason = (
        F.when(F.col("file").isNull(), "no file header")
        .when(F.regexp_extract("_line", _HUNK, 1) == "", "not a hunk")
        .when(F.col("start").isNull() | F.col("_count").isNull(), "not a number")
        .when(F.col("start").cast("long") + F.col("_count") - 1 > 2147483647, "not a line range")
    )
    rows = rows.withColumn("reason", reason)
    end = F.when(F.col("_count") == 0, F.col("start")).otherwise(F.col("start") + F.col("_count") - 1)
    good = rows.where("reason IS NULL").select(*keys, "file", "start", end.alias("end"), (F.col("_count") == 0).alias("deleted"))
    return good, rows.where("reason IS NOT NULL").select(*keys, "file", F.col("_line").alias("value"), "reason")


def parse_patches(patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patches without context, one per row (``…, value``), as new-side line ranges:
    ``…, file, start, end, deleted``, and the hunks that cannot be read:
    ``…, file, value, reason``.

    A ``+++`` header names the file of the hunks below it; a deleted file has
    none. A count of 0 is a pure deletion after ``start``.
    """
    keys = [c for c in patches.columns if c not in ("value", "path")]
    sections = F.split("value", r"(?:^|\n)\+\+\+ ")
    named = F.posexplode(sections).alias("_n", "_s")
    head = F.when(F.col("_n") > 0, F.substring_index("_s", "\n", 1))
    lines = F.regexp_extract_all("_s", F.lit(r"(?m)^(@@[^\n]*)"), 1)
    marked = patches.select(*keys, named).select(*keys, head.alias("_head"), F.explode(lines).alias("_line"))
    return _hunks(marked, keys)


def _marks(spark: SparkSession, path: str) -> DataFrame:
    """The lines of patches that say where others belong, by file and place: ``…, path, pos, value``.

    Files are read in splits, so a large patch is read by many tasks. A line's
    place is the start of its split and its number there among such lines, which
    are longer than the numbers' steps.
    """
    keep = F.col("value").startswith("+++ ") | F.col("value").startswith("@@") | F.col("value").startswith(COMMIT_MARK)
    full = StructType([StructField("value", StringType()), *[StructField(k, StringType()) for k in SNAP]])
    lines = spark.read.schema(full).option("basePath", path).text(path)
    lines = lines.select(*SNAP, "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"))
    found = settle(lines.where(keep).withColumn("_row", F.monotonically_increasing_id()), "patch-marks")
    number = F.row_number().over(Window.partitionBy("path", "_at").orderBy("_row"))
    return found.select(*SNAP, "path", (F.col("_at") + number - 1).alias("pos"), "value")


def _read_patches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Hunks and rejected ones of patch files, with the place of the commit above them."""
    value, keys = F.col("value"), [*SNAP, "path"]
    head = F.when(value.startswith("+++ "), F.substring("value", 5, 2147483647)).when(value.startswith(COMMIT_MARK), F.lit("\0"))
    marks = ordered.running_last(_marks(spark, path), keys, "pos", head, "_head")
    marks = ordered.running_last(marks, keys, "pos", F.when(value.startswith(COMMIT_MARK), F.col("pos")), "_commit")
    place = F.when(F.col("_commit").isNotNull(), F.concat_ws(":", F.xxhash64("path").cast("string"), F.col("_commit").cast("string")))
    lines = marks.where(value.startswith("@@")).select(
        *keys, place.alias("commit"), F.when(F.col("_head") != "\0", F.col("_head")).alias("_head"), value.alias("_line")
    )
    return _hunks(lines, [*keys, "commit"])


def read_diffs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Work-tree diffs against a base: hunks without a commit, and those that cannot be read."""
    hunks, rejected = _read_patches(spark, path)
    return hunks.drop("path").withColumn("commit", F.lit(None).cast("string")), rejected.drop("commit")


def read_log_patches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Logs with patches: hunks per commit, and those that cannot be read."""
    hunks, rejected = _read_patches(spark, path)
    return hunks.drop("path").where("commit IS NOT NULL"), rejected


# --- text, notes, events ----------------------------------------------------


def split_lines(files: DataFrame) -> DataFrame:
    """Whole files (``…, file, value``) as numbered lines: ``…, file, n, text``."""
    keys = [c for c in files.columns if c not in ("value", "path")]
    return files.select(*keys, F.posexplode(F.split("value", "\n")).alias("_i", "text")).select(
        *keys, (F.col("_i") + 1).alias("n"), "text"
    )


_TREE = r"/repo=([^/]+)/snapshot_id=([^/]+)/(.*)$"


def read_source_lines(spark: SparkSession, path: str) -> DataFrame:
    """Source trees below ``repo=…/snapshot_id=…/`` as numbered lines.

    The tree's own folders are no partitions, so the keys come from the file
    path; a filter on them still skips files before they are opened.
    """
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    where = F.col("_metadata.file_path")
    names = ["repo", "snapshot_id", "file"]
    part = [F.url_decode(F.regexp_extract(where, _TREE, i + 1)).alias(n) for i, n in enumerate(names)]
    return split_lines(rows.select(*part, "value"))


def line_range(source_lines: DataFrame, file: str, first: int, last: int) -> DataFrame:
    return source_lines.where((F.col("file") == file) & F.col("n").between(first, last))


def read_notes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(notes, rejected)`` of note files."""
    read = _json(spark, path, S.NOTE_JSON, ["repo"])
    notes = read.where("_broken IS NULL").select("repo", *[f.name for f in S.NOTE_JSON.fields])
    return notes, _unreadable(read, ["repo"], "note file")


def parse_edit_events(events: DataFrame) -> DataFrame:
    """Edit payloads (``…, value`` JSON) as one row per edited Go source file;
    works on a stream as well."""
    keys = [c for c in events.columns if c not in ("value", "path")]
    doc = F.from_json("value", S.EDIT_JSON)
    listed = F.concat(
        F.array(F.col("_d.tool_input.file_path")),
        F.coalesce(F.transform("_d.tool_input.edits", lambda e: e["file_path"]), F.expr("array()").cast("array<string>")),
    )
    return (
        events.withColumn("_d", doc)
        .select(*keys, F.explode(F.array_distinct(listed)).alias("file"))
        .where(paths.is_checked_go_file("file"))
    )


def read_edit_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_edit_events(_text(spark, path, ["repo"], wholetext=True))
