"""Column expressions for text and paths (all built-in, codegen-friendly)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line boundaries of Python's str.splitlines().
# \r\n counts as one boundary; the others are single characters:
# \n \r \x0b \x0c \x1c \x1d \x1e \x85
LINE_BREAK_REGEX = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"

# Characters removed by Python's str.strip() (Unicode White_Space
# plus the separators \x1c-\x1f), written as a Java regex class.
PY_WHITESPACE_CLASS = (
    r"[\t\n\x0B\x0C\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A"
    r"\u2028\u2029\u202F\u205F\u3000]"
)


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def splitlines(text) -> Column:
    """Array of lines with str.splitlines() semantics.

    Splits on every Python line boundary and drops the empty element that
    follows a trailing line break; the empty string gives an empty array.
    """
    parts = F.split(as_col(text), LINE_BREAK_REGEX, -1)
    return F.when(
        F.element_at(parts, -1) == F.lit(""),
        F.slice(parts, 1, F.size(parts) - 1),
    ).otherwise(parts)


def line_count(text) -> Column:
    """len(text.splitlines()) without materialising an exploded table."""
    return F.size(splitlines(text))


def lstrip_py(c) -> Column:
    return F.regexp_replace(as_col(c), "^" + PY_WHITESPACE_CLASS + "+", "")


def path_sort_key(path) -> Column:
    """A string whose byte order equals the order of the path's parts.

    ``pathlib`` sorts by the tuple of parts, so ``a/b`` precedes ``a-b``.
    Replacing the separator by \\x01 (below every printable character) gives
    the same order with a plain string comparison, which range partitioning
    and sort-merge keys handle natively.
    """
    return F.translate(as_col(path), "/", "\x01")


def first_part(path) -> Column:
    return F.substring_index(as_col(path), "/", 1)


def n_parts(path) -> Column:
    return F.size(F.split(as_col(path), "/"))


def layer_of(path, root_name: str = "root") -> Column:
    """First directory of a relative path, or ``root`` for top-level files."""
    p = as_col(path)
    return F.when(p.contains("/"), first_part(p)).otherwise(F.lit(root_name))


def module_key(path, suffix: str = ".py") -> Column:
    """Dotted module name of a relative path (``a/b/__init__.py`` -> ``a.b``).

    A root ``__init__.py`` gives the empty string.
    """
    p = F.regexp_replace(as_col(path), "/+$", "")
    if suffix:
        p = F.regexp_replace(p, re.escape(suffix) + "$", "")
    p = F.regexp_replace(p, "(^|/)__init__$", "")
    return F.translate(p, "/", ".")


# ---------------------------------------------------------------------------
# Glob dialects. Patterns are parameters (a handful of short strings), so they
# are translated to regular expressions once on the driver and evaluated by
# the JVM with rlike; no Python runs per row.
# ---------------------------------------------------------------------------

def _segment_regex(seg: str, any_char: str, star: str) -> str:
    out, i, n = [], 0, len(seg)
    while i < n:
        ch = seg[i]
        if ch == "*":
            out.append(star)
        elif ch == "?":
            out.append(any_char)
        elif ch == "[":
            j = i + 1
            if j < n and seg[j] == "!":
                j += 1
            if j < n and seg[j] == "]":
                j += 1
            while j < n and seg[j] != "]":
                j += 1
            if j >= n:
                out.append(re.escape(ch))
            else:
                body = seg[i + 1:j].replace("\\", "\\\\")
                if body.startswith("!"):
                    body = "^" + body[1:]
                elif body.startswith("^"):
                    body = "\\" + body
                out.append("[" + body + "]")
                i = j
        else:
            out.append(re.escape(ch))
        i += 1
    return "".join(out)


def fnmatch_regex(pattern: str) -> str:
    """fnmatch dialect: ``*`` and ``?`` also match ``/``; whole-string match."""
    return "^" + _segment_regex(pattern, "(?s:.)", "(?s:.*)") + "$"


def pathlib_glob_regex(pattern: str) -> str:
    """``Path.glob`` dialect relative to the root.

    ``*``/``?`` stay inside one part; a ``**`` part matches zero or more
    directories. A trailing ``**`` selects everything below (files included).
    """
    parts = [p for p in pattern.split("/") if p not in ("", ".")]
    out = []
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out.append("(?:[^/]+/)*" if not last else "(?:[^/]+/)*[^/]+")
        else:
            out.append(_segment_regex(part, "[^/]", "[^/]*") + ("" if last else "/"))
    return "^" + "".join(out) + "$"


def matches_any(path, regexes: list[str]) -> Column:
    p = as_col(path)
    cond = F.lit(False)
    for r in regexes:
        cond = cond | p.rlike(r)
    return cond


def identifiers(text, pattern: str = r"[\p{L}\p{N}_]+") -> Column:
    """All identifier-like words of a string, in order."""
    return F.expr(f"regexp_extract_all({_sql(text)}, '{_sql_lit(pattern)}', 0)")


def _sql(c) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("pass a column name")


def _sql_lit(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'")


def is_snake_case(c) -> Column:
    return as_col(c).rlike("^[a-z_][a-z0-9_]*$")


def is_pascal_case(c) -> Column:
    return as_col(c).rlike("^[A-Z][a-zA-Z0-9]*$")


def is_upper(c) -> Column:
    """Python str.isupper(): some cased character and none lower-case."""
    x = as_col(c)
    return (F.upper(x) == x) & (F.lower(x) != x)


def contains_any(c, tokens: list[str]) -> Column:
    x = as_col(c)
    cond = F.lit(False)
    for t in tokens:
        cond = cond | x.contains(t)
    return cond


def first_contained(c, tokens: list[str]) -> Column:
    """First token, in list order, that occurs in the string (else null)."""
    x = as_col(c)
    return F.coalesce(*[F.when(x.contains(t), F.lit(t)) for t in tokens]) \
        if tokens else F.lit(None).cast("string")
