"""Operator 13, secret scans by assignment-aware lexing.

Three base patterns find plain forms: ``assign`` (a keyword, an operator, a
value), ``access`` (access key ids) and ``hex`` (long runs of hex digits). The
method reads what patterns cannot: lines that hold an operator are lexed into
names, strings, bare values and operators, as source and configuration files have
them (``a = "x"``, ``a: str = "x"``, ``"a": "x"``, ``a: x``, ``A=x``, ``a => 'x'``,
``c["a"] = "x"``, ``f(a="x")``, ``f("a", "x")``, ``--a x``, ``<a>x</a>``). Pairs of a name and the
literals of its value come out; a value that names an earlier or later constant,
also inside ``${A}``, or joins several by ``+``, takes that constant's literals.
A literal counts by how sensitive its target's name is and how much it says; a
constant is named where it is written, under the kind ``flow``.

A text is read in one task, whole; tasks share nothing.

Defined results: a null or empty text has no spans; a repeated row is scanned
again; a null doc_id stays null; an empty table gives no rows; other columns are
not read, whatever their names. Positions count code points, the end excluded.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long,name:string,score:double>>"

# The base patterns, the kinds in their order, the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so the least length may stand in the pattern
KINDS = ("assign", "access", "hex", "literal", "flow")
LEAST = 0.5

# How sensitive the words of a name are, and words that say it is about something else.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "authorization": 0.8, "bearer": 0.8, "jwt": 0.8, "pat": 0.6, "dsn": 0.6, "auth": 0.6,
}
KEY_OF = {"api", "access", "private", "signing", "encryption", "master", "auth", "account", "service", "client", "ssh", "license"}
OTHER = {"public", "length", "len", "name", "path", "file", "dir", "url", "uri", "hint", "field", "label", "policy", "ttl", "expiry", "expires", "count", "type", "id", "prompt", "min", "max"}
EMPTY = re.compile(r"(?i)(example|sample|dummy|placeholder|change_?me|your[_-]|todo|redacted|x{4,}|\*{3,}|\.{3})|^(true|false|null|none|nil|undefined)$|^<.*>$|^[$%]?\{.*\}$")

OPERATOR = re.compile(r"""[=:]|<[A-Za-z]|(?<!\S)--?[A-Za-z]|\(["']""")
LEX = re.compile(
    r"""(?P<string>(?<!\\)"(?:\\.|[^"\\])*"|(?<![\w\\])'(?:\\.|[^'\\])*'|(?<!\\)`(?:\\.|[^`\\])*`)
      |<(?P<tag>[A-Za-z][\w.:-]*)>(?P<inner>[^<>]*)</(?P=tag)>
      |(?<!\S)--?(?P<flag>[A-Za-z][\w.-]*)(?:=|\x20+)(?P<given>[^\s"'=-][^\s"'|;&]*)
      |(?P<assign>:=|=>|\?=|\|\|=|\+=|(?<![=!<>])=(?![=~])|:(?![:/]))
      |(?P<plus>\+)
      |(?P<name>[A-Za-z_$@][\w$]*(?:(?:->|::|[.-])[A-Za-z_]\w*)*(?![^\s,;:=\[\](){}<>"'+`|&]))
      |(?P<bare>[^\s,;:=\[\](){}<>"'`|&][^\s,;\[\](){}<>"'`|&]*)
      |(?P<mark>[\[\](){},;<>])""",
    re.X,
)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
HOLE = re.compile(r"\$\{?([A-Za-z_]\w*)\}?|(?<!\$)\{([A-Za-z_]\w*)\}")

Literal = tuple[int, int, bool]  # start, end, quoted


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the three patterns, leftmost and not overlapping within a kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def sensitivity(name: str) -> float:
    """How likely a name's values are secret, from 0 to 1."""
    words = [w.lower() for w in WORDS.findall(name)]
    best = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    if any(b in ("key", "keys") and a in KEY_OF for a, b in zip(words, words[1:], strict=False)):
        best = max(best, 0.9)
    return best * (0.3 if words and words[-1] in OTHER or "public" in words else 1.0)


def substance(value: str, quoted: bool) -> float:
    """How much a literal says, from 0 to 1: nothing if short, a placeholder or a plain word."""
    if len(value) < 6 or EMPTY.search(value) or (not quoted and value.isalpha()):
        return 0.0
    n = len(value)
    bits = -sum(c * math.log2(c / n) for c in Counter(value).values())
    return min(1.0, bits / 24) * (0.4 if any(c.isspace() for c in value) else 1.0)


def lines(text: str) -> Iterator[tuple[int, int]]:
    """The lines that hold an operator."""
    end = -1
    for m in OPERATOR.finditer(text):
        if m.start() >= end:
            start = text.rfind("\n", 0, m.start()) + 1
            end = text.find("\n", m.start())
            end = len(text) if end < 0 else end
            yield start, end


def pairs(text: str) -> list[tuple[str, list[Literal | str]]]:
    """Names with the literals and names of their values, in order."""
    out: list[tuple[str, list[Literal | str]]] = []
    for lo, hi in lines(text):
        held: list[str] = []  # names that the value to come belongs to
        last: tuple[str, str] | None = None  # the token before, if it may be a name: kind, name
        value: list[Literal | str] | None = None
        joined = opened = False
        for m in LEX.finditer(text, lo, hi):
            kind = m.lastgroup if m.lastgroup not in ("inner", "given") else ("tag" if m.lastgroup == "inner" else "flag")
            if kind == "tag":
                out.append((m["tag"], [(m.start("inner"), m.end("inner"), False)]))
                last = value = None
                held = []
            elif kind == "flag":
                out.append((m["flag"], [(m.start("given"), m.end("given"), False)]))
                last = value = None
                held = []
            elif kind == "assign":
                if last:  # the name before it; in "a: type = x" the value is both names'
                    held = [*(held[:1] if value is not None and not joined else []), last[1]]
                    value, joined = [], False
                last = None
            elif kind in ("string", "name", "bare"):
                a, b = (m.start() + 1, m.end() - 1) if kind == "string" else m.span()
                word = text[a:b]
                if value is not None and held:
                    if not value or joined or kind == "string" and isinstance(value[-1], tuple) and value[-1][2]:
                        value.append(word if kind == "name" else (a, b, kind == "string"))
                        if kind == "name":  # a configuration's bare word may be the value itself
                            value.append((a, b, False))
                        out += [(n, value) for n in held if (n, value) not in out[-4:]]
                        joined = False
                    else:
                        value, held = None, []
                last = (kind, word) if kind in ("string", "name") or kind == "bare" else None
            elif kind == "plus":
                joined = value is not None and bool(value)
                last = None
            elif m["mark"] == "]":
                pass  # c["a"] = x: the string before stays the name
            elif m["mark"] == "," and opened and last:  # f("a", x)
                held, value, joined, opened, last = [last[1]], [], False, False, None
            else:
                opened = m["mark"] == "("
                value, held = None, []
                last = None
    return out


def short(name: str) -> str:
    return re.split(r"->|::|\.", name)[-1]


def found(text: str) -> list[tuple[str, int, int, str, float]]:
    """Literals of sensitive targets: kind, start, end, the target's name, score.

    The most sensitive targets go first, so a constant is followed once only,
    for the target that says most about it.
    """
    told = pairs(text)
    constants: dict[str, list[Literal | str]] = {}
    for name, value in told:
        constants.setdefault(short(name), value)

    def parts(value: list[Literal | str]) -> tuple[list[Literal], list[str]]:
        """The literals of a value and the constants that it names."""
        own, named, known = [], [], False
        for x in value:
            if isinstance(x, str):
                known = short(x) in constants
                named += [short(x)] * known
            elif not known or x[2]:
                known = False
                own.append(x)
                named += [h[1] or h[2] for h in HOLE.finditer(text, x[0], x[1]) if (h[1] or h[2]) in constants]
        return own, named

    how = {name: sensitivity(name) for name, _ in told}
    best: dict[tuple[int, int], tuple[str, int, int, str, float]] = {}

    def offer(kind: str, literals: list[Literal], name: str) -> None:
        for lo, hi, quoted in literals:
            score = how[name] * substance(text[lo:hi], quoted)
            old = best.get((lo, hi))
            if score >= LEAST and (not old or (score, kind == "literal") > (old[4], old[0] == "literal")):
                best[lo, hi] = (kind, lo, hi, name, score)

    followed: set[str] = set()
    for name, value in sorted((x for x in told if how[x[0]] >= LEAST), key=lambda x: -how[x[0]]):
        own, open_ = parts(value)
        offer("literal", own, name)
        while open_:
            c = open_.pop()
            if c not in followed:
                followed.add(c)
                own, more = parts(constants[c])
                offer("flow", own, name)
                open_ += more
    return list(best.values())


def spans(text: str | None) -> list[tuple[str, int, int, str | None, float | None]]:
    """All spans of a text, by start and kind: the patterns', and literals that no ``assign`` has already."""
    if not text:
        return []
    base = base_spans(text)
    out: list[tuple[str, int, int, str | None, float | None]] = [(*x, None, None) for x in base]
    added = found(text)
    if added:
        have, at = [(a, b) for k, a, b in base if k == "assign"], 0
        for x in sorted(added, key=lambda x: x[1:3]):
            while at < len(have) and have[at][1] < x[2]:
                at += 1
            if at == len(have) or have[at][0] > x[1]:
                out.append(x)
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its spans: kind, start, end, and of added ones the target's name and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])
        names = [f.name for f in span]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [[dict(zip(names, x, strict=True)) for x in spans(t)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(span))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SPANS)


def digest(found: DataFrame) -> DataFrame:
    """Counts, digest and text of the spans of ``scan``."""
    base = "filter(spans, s -> s.kind in ('assign', 'access', 'hex'))"
    text = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS[:3]],
        F.expr(f"sha2({text.format(base)}, 256)").alias("base_sha256"),
        F.expr(text.format("spans")).alias("spans"),
    )
