"""Explicit schemas. A NULL is "not measured", never zero.

Lists that can grow without bound (line states, mutants, neighbours) are kept
as child tables with one row per element instead of arrays inside one row.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# Versions that readers accept (fixed values).
SNAPSHOT_VERSION = 1
COVERAGE_CACHE_VERSION = 1
MUTATION_CACHE_VERSION = 1

# Node and edge kinds (fixed values).
MODULE, PACKAGE, FUNC, TYPE, EXTERNAL = "module", "package", "func", "type", "external"
NODE_KINDS = [MODULE, PACKAGE, FUNC, TYPE, EXTERNAL]
IMPORTS, CALLS, CALLS_DYNAMIC, IMPLEMENTS = "imports", "calls", "calls_dynamic", "implements"
EDGE_KINDS = [IMPORTS, CALLS, CALLS_DYNAMIC, IMPLEMENTS]

# Mutant statuses (fixed values).
KILLED, LIVED, NOT_COVERED, TIMED_OUT = "KILLED", "LIVED", "NOT COVERED", "TIMED OUT"
COUNTED = [KILLED, LIVED, NOT_COVERED, TIMED_OUT]

# Every table is keyed by these two columns first.
SNAP = ["repo", "snapshot_id"]


def _s(*fields: tuple) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


STR, INT, LONG, DBL, BOOL, TS = (
    StringType(),
    IntegerType(),
    LongType(),
    DoubleType(),
    BooleanType(),
    TimestampType(),
)
INTS = ArrayType(INT)
_KEY = [("repo", STR), ("snapshot_id", STR)]

FIELD = _s(("name", STR), ("type", STR))
LINES = _s(("covered", INTS), ("uncovered", INTS), ("partial", INTS))
MUTANT = _s(("line", INT), ("col", INT), ("type", STR), ("status", STR), ("description", STR))

NODE_FIELDS = [
    ("id", STR),
    ("kind", STR),
    ("name", STR),
    ("parent", STR),
    ("dir", STR),
    ("file", STR),
    ("line", INT),
    ("end_line", INT),
    ("doc_line", INT),
    ("exported", BOOL),
    ("recv", STR),
    ("ptr_recv", BOOL),
    ("signature", STR),
    ("body_hash", STR),
    ("type_kind", STR),
    ("fields", ArrayType(FIELD)),
    ("pure", BOOL),
    ("effects", ArrayType(STR)),
    ("errors", ArrayType(STR)),
]
NODE_JSON = _s(*NODE_FIELDS)
EDGE_JSON = _s(("from", STR), ("to", STR), ("kind", STR))
METRICS_JSON = _s(
    ("cc", INT),
    ("cognitive", INT),
    ("loc", INT),
    ("churn", INT),
    ("churn_scope", STR),
    ("coverage", _s(("stmts", INT), ("covered", INT), ("percent", DBL), ("stale", BOOL), ("lines", LINES))),
    ("crap", DBL),
    (
        "mutation",
        _s(
            ("killed", INT),
            ("survived", INT),
            ("not_covered", INT),
            ("timed_out", INT),
            ("score", DBL),
            ("stale", BOOL),
            ("mutants", ArrayType(MUTANT)),
        ),
    ),
    ("grades", _s(("crap", INT), ("mutation", INT), ("coverage", INT), ("combined", INT))),
    ("crap_max", DBL),
    ("crap_avg", DBL),
    ("worst", STR),
    ("coverage_error", STR),
    ("mutation_error", STR),
)
GRAPH_JSON = _s(
    ("nodes", ArrayType(NODE_JSON)),
    ("edges", ArrayType(EDGE_JSON)),
    ("metrics", MapType(STR, METRICS_JSON)),
)
SNAPSHOT_JSON = StructType(
    _s(
        ("schema", INT),
        ("tool_version", STR),
        ("module", STR),
        ("generated", TS),
        ("git", _s(("head", STR), ("dirty", BOOL))),
        ("runs", _s(("structure", TS), ("coverage", TS), ("mutation", TS))),
    ).fields
    + GRAPH_JSON.fields
)
COVERAGE_CACHE_JSON = _s(
    ("schema", INT),
    ("ran_at", TS),
    (
        "functions",
        MapType(
            STR,
            _s(
                ("body_hash", STR),
                ("ran_at", TS),
                ("stmts", INT),
                ("covered", INT),
                ("covered_offsets", INTS),
                ("uncovered_offsets", INTS),
                ("partial_offsets", INTS),
            ),
        ),
    ),
    ("package_errors", MapType(STR, STR)),
)
CACHED_MUTANT = _s(("line_offset", INT), ("col", INT), ("type", STR), ("status", STR), ("description", STR))
MUTATION_CACHE_JSON = _s(
    ("schema", INT),
    ("package", STR),
    ("engine", STR),
    ("engine_version", STR),
    ("ran_at", TS),
    ("error", STR),
    (
        "functions",
        MapType(
            STR,
            _s(
                ("body_hash", STR),
                ("engine", STR),
                ("engine_version", STR),
                ("ran_at", TS),
                ("counts", _s(("killed", INT), ("survived", INT), ("not_covered", INT), ("timed_out", INT))),
                ("mutants", ArrayType(CACHED_MUTANT)),
            ),
        ),
    ),
)
MUTATION_REPORT_JSON = _s(
    ("go_module", STR),
    (
        "files",
        ArrayType(
            _s(
                ("file_name", STR),
                ("mutations", ArrayType(_s(("type", STR), ("status", STR), ("line", INT), ("column", INT)))),
            )
        ),
    ),
)
NOTE_JSON = _s(
    ("id", STR),
    ("target", STR),
    ("line_offset", INT),
    ("line_text", STR),
    ("author", STR),
    ("text", STR),
    ("created", TS),
    ("resolved", BOOL),
)
EDIT_JSON = _s(
    ("cwd", STR),
    ("tool_input", _s(("file_path", STR), ("edits", ArrayType(_s(("file_path", STR)))))),
)

# Flat tables.
NODES = _s(*_KEY, *NODE_FIELDS)
EDGES = _s(*_KEY, ("from", STR), ("to", STR), ("kind", STR))
FACTS = _s(*_KEY, ("id", STR), ("cc", INT), ("cognitive", INT), ("loc", INT))
EFFECT_FACTS = _s(
    *_KEY, ("id", STR), ("ord", INT), ("kind", STR), ("package", STR), ("name", STR), ("has_receiver", BOOL)
)
BLOCKS = _s(
    *_KEY,
    ("file", STR),
    ("start_line", INT),
    ("start_col", INT),
    ("end_line", INT),
    ("end_col", INT),
    ("num_stmt", INT),
    ("count", LONG),
)
FILE_MUTANTS = _s(*_KEY, ("file", STR), ("line", INT), ("col", INT), ("type", STR), ("status", STR))
COVERAGE = _s(
    *_KEY,
    ("id", STR),
    ("stmts", LONG),
    ("covered", LONG),
    ("percent", DBL),
    ("stale", BOOL),
    ("lines_known", BOOL),
    ("reached", BOOL),
)
LINE_STATES = _s(*_KEY, ("id", STR), ("line", INT), ("state", STR))
MUTATION = _s(
    *_KEY,
    ("id", STR),
    ("killed", LONG),
    ("survived", LONG),
    ("not_covered", LONG),
    ("timed_out", LONG),
    ("score", DBL),
    ("stale", BOOL),
)
MUTANTS = _s(
    *_KEY,
    ("id", STR),
    ("line", INT),
    ("col", INT),
    ("type", STR),
    ("status", STR),
    ("description", STR),
)
COVERAGE_CACHE = _s(
    ("repo", STR), ("id", STR), ("body_hash", STR), ("ran_at", TS), ("stmts", LONG), ("covered", LONG)
)
COVERAGE_CACHE_LINES = _s(("repo", STR), ("id", STR), ("line_offset", INT), ("state", STR))
COVERAGE_ERRORS = _s(("repo", STR), ("package", STR), ("error", STR))
MUTATION_CACHE = _s(
    ("repo", STR),
    ("package", STR),
    ("engine", STR),
    ("engine_version", STR),
    ("ran_at", TS),
    ("id", STR),
    ("body_hash", STR),
    ("killed", LONG),
    ("survived", LONG),
    ("not_covered", LONG),
    ("timed_out", LONG),
)
MUTATION_CACHE_MUTANTS = _s(
    ("repo", STR),
    ("package", STR),
    ("id", STR),
    ("line_offset", INT),
    ("col", INT),
    ("type", STR),
    ("status", STR),
    ("description", STR),
)
MUTATION_RUNS = _s(("repo", STR), ("package", STR), ("ran_at", TS), ("error", STR))
COMMIT_FILES = _s(("repo", STR), ("commit", STR), ("ts", TS), ("file", STR))
HUNKS = _s(*_KEY, ("commit", STR), ("file", STR), ("start", INT), ("end", INT), ("deleted", BOOL))
SOURCE_LINES = _s(*_KEY, ("file", STR), ("n", INT), ("text", STR))
NOTES = _s(("repo", STR), *[(f.name, f.dataType) for f in NOTE_JSON.fields])
THRESHOLDS = _s(
    ("repo", STR),
    ("crap_max", DBL),
    ("cognitive_max", INT),
    ("coverage_min", DBL),
    ("mutation_min", DBL),
)
CRITICAL_PATHS = _s(("repo", STR), ("pattern", STR))
EDIT_EVENTS = _s(("repo", STR), ("ts", TS), ("file", STR), ("op", STR))
ACTIVITY = _s(("client", STR), ("ts", TS))
