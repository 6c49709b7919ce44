"""Names, paths and glob patterns as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# White space that :func:`strip` removes (fixed value).
SPACE = " \t\n\r\x0b\f\u0085\u00a0"


def strip(text: Column | str) -> Column:
    """Text without white space on either side, tabs and line ends included."""
    return F.btrim(_c(text), F.lit(SPACE))


def short(node_id: Column | str) -> Column:
    """Last path element: ``a/b/pricing.Apply`` gives ``pricing.Apply``."""
    return F.substring_index(_c(node_id), "/", -1)


def dirname(path: Column | str) -> Column:
    """Directory of a path, ``.`` for a file at the root."""
    p = _c(path)
    return F.when(F.instr(p, "/") == 0, F.lit(".")).otherwise(F.regexp_extract(p, r"(?s)^(.*)/[^/]*$", 1))


def method_owner(node_id: Column | str) -> Column:
    """``p.T`` for ``p.T.M``; NULL without a dot after the first character."""
    owner = F.regexp_extract(_c(node_id), r"(?s)^(.+)\.[^.]*$", 1)
    return F.when(owner != "", owner)


def method_name(node_id: Column | str) -> Column:
    return F.substring_index(_c(node_id), ".", -1)


def trim_major(module: Column | str) -> Column:
    """Drop a final ``/v<digits>`` element."""
    return F.regexp_replace(_c(module), r"(?<=.)/v[0-9]+$", "")


def module_short(module: Column | str) -> Column:
    return short(trim_major(module))


def external_name(module: Column | str) -> Column:
    """Display name of an external module: no host, no major version."""
    m = trim_major(module)
    return F.regexp_replace(m, r"^[^/]*\.[^/]*/", "")


def parent_prefix(prefix: Column | str) -> Column:
    """Enclosing group prefix, empty at the top."""
    return F.regexp_extract(_c(prefix), r"^(.*)/[^/]*$", 1)


def clean_path(path: Column | str) -> Column:
    """Slash path without empty, ``.`` and resolvable ``..`` elements."""
    parts = F.filter(F.split(_c(path), "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.expr("cast(array() as array<string>)"),
        lambda acc, p: F.when(
            (p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."),
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
        ).otherwise(F.concat(acc, F.array(p))),
    )
    joined = F.array_join(folded, "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def is_checked_go_file(path: Column | str) -> Column:
    """Source files that matter to checks: Go, but not Go tests."""
    p = _c(path)
    return p.endswith(".go") & ~p.endswith("_test.go")


def parent_package(node_id: Column | str) -> Column:
    """Package part of a function id: up to the first dot after the last slash."""
    return F.regexp_extract(_c(node_id), r"^((?:.*/)?[^./]*)", 1)


_NEVER = r"(?!)"


def _segment(seg: str) -> str | None:
    """One glob segment as a regular expression; None when malformed."""
    out, i = [], 0
    while i < len(seg):
        ch = seg[i]
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "\\":
            i += 1
            if i == len(seg):
                return None
            out.append(re.escape(seg[i]))
        elif ch == "[":
            m = re.match(r"\[(\^?)((?:\\.|[^\\\]])(?:\\.|[^\\\]])*)\]", seg[i:])
            if not m:
                return None
            items = re.findall(r"\\.|.", m.group(2), re.S)
            cls, j = [], 0
            while j < len(items):
                lo = items[j][-1]
                if items[j] == "-":
                    return None
                if j + 1 < len(items) and items[j + 1] == "-":
                    if j + 2 >= len(items) or items[j + 2] == "-":
                        return None
                    cls.append(f"{re.escape(lo)}-{re.escape(items[j + 2][-1])}")
                    j += 3
                else:
                    cls.append(re.escape(lo))
                    j += 1
            neg = "^" if m.group(1) else ""
            body = "".join(cls).replace("[", r"\[").replace("&&", r"&\&")
            out.append(f"(?!/)[{neg}{body}]")
            i += len(m.group(0)) - 1
        else:
            out.append(re.escape(ch))
        i += 1
    return "".join(out)


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob.

    ``**`` stands for any number of whole segments, none included; every other
    segment stays within its slashes. A malformed pattern matches nothing.
    """
    segs = pattern.split("/")
    if segs == ["**"]:
        return r"(?s)\A.*\z"
    out, sep = "", ""
    for i, seg in enumerate(segs):
        if seg == "**":
            if i == len(segs) - 1:
                out += "(?:/[^/]*)*" if sep else "(?:[^/]*(?:/[^/]*)*)?"
                sep = ""
            else:
                out += sep + "(?:[^/]*/)*"
                sep = ""
            continue
        rx = _segment(seg)
        if rx is None:
            return _NEVER
        out += sep + rx
        sep = "/"
    return rf"(?s)\A{out}\z"


def matches_glob(path: Column | str, patterns: list[str]) -> Column:
    """True where the path matches any of the patterns."""
    regexes = [glob_regex(p) for p in patterns]
    if not regexes:
        return F.lit(False)
    return F.coalesce(_c(path).rlike("|".join(f"(?:{r})" for r in regexes)), F.lit(False))
