"""Coverage: profiles to functions, line states, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.paths import clean_path, dirname
from plumbline.functions.scores import coverage_percent
from plumbline.operators.intervals import FILE, contained_spans, function_slices, slice_of
from plumbline.operators.ordered import runs
from plumbline.schemas import SNAP
from plumbline.session import joined_by_some_keys, settle

ID = SNAP + ["id"]
POSITION = ["start_line", "start_col", "end_line", "end_col", "num_stmt"]


def merge_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks reported by several test binaries become one; counts add up."""
    return blocks.groupBy(*FILE, *POSITION).agg(F.sum("count").alias("count"))


def profile_files(blocks: DataFrame) -> DataFrame:
    return blocks.select(*FILE).distinct()


def without_packages(blocks: DataFrame, failed_dirs: DataFrame) -> DataFrame:
    """Drop blocks of files that lie directly in a failed package's directory."""
    d = failed_dirs.select(*SNAP, F.col("dir").alias("_dir")).distinct()
    return blocks.withColumn("_dir", dirname("file")).join(d, SNAP + ["_dir"], "left_anti").drop("_dir")


def relativize(blocks: DataFrame, modules: DataFrame) -> DataFrame:
    """Import-path file names to root-relative paths by the longest module
    path in front of them; files of other modules are dropped.

    ``modules``: ``repo, snapshot_id, module, dir``. Each distinct file is
    expanded to its own path prefixes, so the match is an equality join.
    """
    files = blocks.select(*FILE).distinct()
    parts = F.split("file", "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")
    )
    cand = files.where(F.instr("file", "/") > 0).withColumn("module", F.explode(prefixes))
    best = (
        cand.join(modules.select(*SNAP, "module", "dir"), SNAP + ["module"])
        .groupBy(*FILE)
        .agg(F.max(F.struct(F.length("module").alias("n"), "module", "dir")).alias("m"))
    )
    rest = F.expr("substring(file, m.n + 2)")
    named = best.withColumn("_rel", clean_path(F.concat_ws("/", F.col("m.dir"), rest))).drop("m")
    return blocks.join(named, FILE).withColumn("file", F.col("_rel")).drop("_rel")


def spans_inside(funcs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per function: the distinct line spans of blocks inside it, with the
    statements and hits of all blocks on the span. Coverage and line states
    both start from it, so a job that needs both settles it once.

    Blocks move once: what is merged and what meets a function starts on the
    same line, so it lies in one slice. They meet functions first, and only
    those inside one are merged."""
    hit = F.col("count") > 0
    place = [*FILE, "_slice", "id"]  # the slice spares a shuffle
    return (
        contained_spans(funcs, blocks.select(*FILE, *POSITION, "count"))
        .groupBy(*place, *POSITION)
        .agg(F.sum("count").alias("count"))
        .groupBy(*place, "start_line", "end_line")
        .agg(
            F.sum("num_stmt").alias("stmts"),
            F.sum(F.when(hit, F.col("num_stmt")).otherwise(0)).alias("covered"),
            F.bool_or(hit).alias("ran"),
            F.bool_or(~hit).alias("missed"),
        )
        .drop("_slice")
    )


# Lines of a word, as a power of two.
WORD_BITS = 6


def state_words(funcs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per function and word of 64 lines, written once: ``…, id, _word, stmts, covered, ran, ran_lines, missed_lines``.

    The last two have a bit for every line that a block with hits, or one without, overlaps; statements are
    counted where their block starts. Functions are numbered when they are written, so the many rows of blocks
    are merged by numbers, where they met functions; ids come back to what is left.
    """
    numbered = settle(
        funcs.select(*FILE, "id", "line", "end_line").withColumn("_number", F.monotonically_increasing_id()), "numbered"
    )
    place = [*FILE, "_slice"]
    f = function_slices(numbered, "_number").select(
        *place, "_number", F.col("line").alias("_from"), F.col("end_line").alias("_to"), F.xxhash64(*place).alias("_part")
    )
    b = blocks.select(*FILE, *POSITION, "count", slice_of("start_line").alias("_slice"))
    merged = (
        b.withColumn("_part", F.xxhash64(*place))
        .repartition("_part")
        .join(f.repartition("_part").hint("shuffle_hash"), ["_part", *place])
        .where("start_line >= _from AND end_line <= _to")
        .groupBy("_part", "_number", *POSITION)
        .agg(F.sum("count").alias("count"))
    )
    first, last = F.shiftright("start_line", WORD_BITS), F.shiftright("end_line", WORD_BITS)
    words = F.when(first < last, F.sequence(first, last)).otherwise(F.array(first))
    hit, opens = F.col("count") > 0, F.col("_word") == first
    rest = (1 << WORD_BITS) - 1
    low = F.when(opens, F.col("start_line").bitwiseAND(rest)).otherwise(0).alias("_low")
    high = F.when(F.col("_word") == last, F.col("end_line").bitwiseAND(rest)).otherwise(rest).alias("_high")
    bits = F.expr("if(start_line <= end_line, shiftleft(-1L, _low) & shiftrightunsigned(-1L, 63 - _high), 0L)")
    found = (
        merged.withColumn("_word", F.explode(words))
        .select("*", low, high)
        .withColumn("_bits", bits)
        .groupBy("_part", "_number", "_word")
        .agg(
            F.sum(F.when(opens, F.col("num_stmt")).otherwise(0)).alias("stmts"),
            F.sum(F.when(opens & hit, F.col("num_stmt")).otherwise(0)).alias("covered"),
            F.bool_or(hit).alias("ran"),
            F.bit_or(F.when(hit, F.col("_bits")).otherwise(0)).alias("ran_lines"),
            F.bit_or(F.when(hit, 0).otherwise(F.col("_bits"))).alias("missed_lines"),
        )
        # slices of a function meet
        .repartition("_number")
        .groupBy("_number", "_word")
        .agg(
            F.sum("stmts").alias("stmts"),
            F.sum("covered").alias("covered"),
            F.bool_or("ran").alias("ran"),
            F.bit_or("ran_lines").alias("ran_lines"),
            F.bit_or("missed_lines").alias("missed_lines"),
        )
        .join(numbered.select(*ID, "_number"), "_number")
        .drop("_number")
    )
    with joined_by_some_keys(funcs.sparkSession):
        return settle(found.select(*ID, "_word", "stmts", "covered", "ran", "ran_lines", "missed_lines"), "state-words")


def has_line(mask: Column, line: Column) -> Column:
    """Whether a word's ``mask`` has the bit of one of its lines."""
    return F.call_function("shiftright", mask, line.bitwiseAND((1 << WORD_BITS) - 1).cast("int")).bitwiseAND(1) == 1


def lines_of_words(words: DataFrame) -> DataFrame:
    """:func:`line_states` from :func:`state_words`; no line moves."""
    line = F.col("line")
    return (
        words.select(*ID, "_word", "ran_lines", "missed_lines", F.explode(F.sequence(F.lit(0), F.lit((1 << WORD_BITS) - 1))).alias("_bit"))
        .withColumn("line", F.shiftleft("_word", WORD_BITS) + F.col("_bit"))
        .select(*ID, "line", has_line(F.col("ran_lines"), line).alias("ran"), has_line(F.col("missed_lines"), line).alias("missed"))
        .where("ran OR missed")
        .select(*ID, "line", state_of("ran", "missed").alias("state"))
    )


def function_coverage(funcs: DataFrame, blocks: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Statement coverage per function.

    No row for a function whose file the profile does not mention (not
    measured); zero statements and a NULL percent where the file is mentioned
    but no block lies inside.
    """
    sums = (
        (spans_inside(funcs, blocks) if spans is None else spans)
        .groupBy(*ID)
        .agg(
            F.sum("stmts").alias("stmts"),
            F.sum("covered").alias("covered"),
            F.bool_or("ran").alias("reached"),
        )
    )
    measured = funcs.select(*FILE, "id").join(profile_files(blocks), FILE, "left_semi").select(*ID)
    return (
        measured.join(sums, ID, "left")
        .withColumn("stmts", F.coalesce("stmts", F.lit(0)).cast("long"))
        .withColumn("covered", F.coalesce("covered", F.lit(0)).cast("long"))
        .select(
            *ID,
            "stmts",
            "covered",
            coverage_percent("covered", "stmts").alias("percent"),
            F.lit(False).alias("stale"),
            F.lit(True).alias("lines_known"),
            F.coalesce("reached", F.lit(False)).alias("reached"),
        )
    )


def line_states(funcs: DataFrame, blocks: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """State of every line a block inside a function overlaps."""
    inside = spans_inside(funcs, blocks) if spans is None else spans
    lines = inside.where("start_line <= end_line").withColumn("line", F.explode(F.sequence("start_line", "end_line")))
    return (
        lines.groupBy(*ID, "line")
        .agg(F.bool_or("ran").alias("ran"), F.bool_or("missed").alias("missed"))
        .select(*ID, "line", state_of("ran", "missed").alias("state"))
    )


def state_of(ran: str, missed: str) -> Column:
    return (
        F.when(F.col(ran) & F.col(missed), F.lit("partial"))
        .when(F.col(ran), F.lit("covered"))
        .otherwise(F.lit("uncovered"))
    )


def state_runs(states: DataFrame, state: str) -> DataFrame:
    """Maximal runs of lines in one state: ``repo, snapshot_id, id, start, end``."""
    return runs(states.where(F.col("state") == state), ID, "line")


# --- cache ------------------------------------------------------------------


def to_offset(line: Column | str, base: Column | str) -> Column:
    """Absolute line to offset from the function's first line."""
    return (F.col(line) if isinstance(line, str) else line) - (F.col(base) if isinstance(base, str) else base)


def to_line(offset: Column | str, base: Column | str) -> Column:
    return (F.col(offset) if isinstance(offset, str) else offset) + (F.col(base) if isinstance(base, str) else base)


def resolve_coverage(funcs: DataFrame, cache: DataFrame, cache_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cached results on the current code: ``(coverage, line_states)``.

    Stale where the body changed since; entries of vanished functions drop
    out. Lines move with their function.
    """
    f = funcs.select(*ID, "line", F.col("body_hash").alias("_now"))
    seen = cache_lines.groupBy("repo", "id").agg(
        F.bool_or(F.col("state").isin("covered", "partial")).alias("reached")
    )
    cov = (
        f.join(cache.select("repo", "id", "body_hash", "stmts", "covered"), ["repo", "id"])
        .join(seen, ["repo", "id"], "left")
        .select(
            *ID,
            "stmts",
            "covered",
            coverage_percent("covered", "stmts").alias("percent"),
            (~F.col("body_hash").eqNullSafe(F.col("_now"))).alias("stale"),
            F.lit(True).alias("lines_known"),
            F.coalesce("reached", F.lit(False)).alias("reached"),
        )
    )
    states = (
        cache_lines.select("repo", "id", "line_offset", "state")
        .join(f, ["repo", "id"])
        .select(*ID, to_line("line_offset", "line").alias("line"), "state")
    )
    return cov, states


def _forget(rows: DataFrame, ran: DataFrame) -> DataFrame:
    """Rows whose id does not start with ``<package>.`` of a package that ran.

    An id offers every prefix before a dot of its last path element, so
    deleted functions and dotted package names are found by an equality join.
    """
    head, tail = F.regexp_extract("id", r"^(.*/)?", 0), F.substring_index("id", "/", -1)
    parts = F.split(tail, r"\.")
    ends = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0)
    prefixes = F.transform(ends, lambda i: F.concat(head, F.array_join(F.slice(parts, 1, i), ".")))
    gone = (
        rows.select("repo", "id")
        .distinct()
        .withColumn("package", F.explode(prefixes))
        .join(ran, ["repo", "package"], "left_semi")
        .select("repo", "id")
        .distinct()
    )
    return rows.join(gone, ["repo", "id"], "left_anti")


def update_coverage_cache(
    cache: DataFrame,
    cache_lines: DataFrame,
    errors: DataFrame,
    funcs: DataFrame,
    measured: DataFrame,
    states: DataFrame,
    ran: DataFrame,
    failed: DataFrame,
    at: Column | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A run over the packages ``ran``: their old rows go, the functions of
    the clean ones come in (zero statements where nothing was measured), the
    failed ones keep only their error. Other packages stay as they are.

    ``ran``: ``repo, package`` and, unless ``at`` says when all of them ran,
    ``ran_at``; ``failed``: ``repo, package, error``.
    """
    pkg = ["repo", "package"]
    when = F.col("ran_at") if at is None else at
    times = ran.select(*pkg, when.alias("ran_at")).distinct()
    ran = ran.select(*pkg).distinct()
    failed = failed.join(ran, pkg, "left_semi").select(*pkg, "error").where("error <> ''")
    clean = ran.join(failed, pkg, "left_anti")
    fresh_f = funcs.select(*ID, F.col("parent").alias("package"), "body_hash", F.col("line").alias("_base")).join(
        clean, pkg, "left_semi"
    )
    fresh = fresh_f.join(times, pkg).join(measured.select(*ID, "stmts", "covered"), ID, "left").select(
        "repo",
        "id",
        "body_hash",
        "ran_at",
        F.coalesce("stmts", F.lit(0)).cast("long").alias("stmts"),
        F.coalesce("covered", F.lit(0)).cast("long").alias("covered"),
    )
    fresh_lines = states.join(fresh_f, ID).select(
        "repo", "id", to_offset("line", "_base").cast("int").alias("line_offset"), "state"
    )
    return (
        _forget(cache, ran).unionByName(fresh),
        _forget(cache_lines, ran).unionByName(fresh_lines),
        errors.join(ran, pkg, "left_anti").unionByName(failed),
    )
