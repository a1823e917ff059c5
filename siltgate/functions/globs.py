"""Path globs as anchored regular expressions, built on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def fnmatch_regex(pattern: str) -> str | None:
    """``*`` and ``?`` stop at a slash, ``[...]`` classes (``^`` negates) and ``\\`` escapes; None if malformed."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            i += 1
            if i == len(pattern):
                return None
            out.append(_literal(pattern[i]))
        elif c == "[":
            j, items = i + 1, []
            negate = j < len(pattern) and pattern[j] == "^"
            j += negate
            first = True
            while True:
                if j >= len(pattern):
                    return None
                if pattern[j] == "]" and not first:
                    break
                lo, j = _class_char(pattern, j)
                hi = lo
                if lo is not None and j < len(pattern) and pattern[j] == "-":
                    hi, j = _class_char(pattern, j + 1)
                if lo is None or hi is None:
                    return None
                if lo <= hi:
                    items.append(f"\\x{{{ord(lo):X}}}-\\x{{{ord(hi):X}}}")
                first = False
            if items:
                out.append("[" + ("^" if negate else "") + "".join(items) + "]")
            else:
                out.append("(?s:.)" if negate else "(?!)")
            i = j
        else:
            out.append(_literal(c))
        i += 1
    return "".join(out)


def _literal(c: str) -> str:
    return c if c.isalnum() and ord(c) < 128 or c in "/_" else f"\\x{{{ord(c):X}}}"


def _class_char(pattern: str, i: int) -> tuple[str | None, int]:
    """A character of a class and the place after it; None where the class is malformed."""
    if i >= len(pattern) or pattern[i] in "-]":
        return None, i
    if pattern[i] == "\\":
        i += 1
        if i >= len(pattern):
            return None, i
    return pattern[i], i + 1


def segments_regex(pattern: str) -> str | None:
    """Regex over ``a/b/`` (non-empty segments): ``**`` is any number of whole segments."""
    out = []
    for part in (p for p in pattern.split("/") if p):
        if part == "**":
            out.append("(?:[^/]+/)*")
        else:
            r = fnmatch_regex(part)
            if r is None:
                return None
            out.append(r + "/")
    return "".join(out)


def is_malformed(pattern: str) -> bool:
    return any(fnmatch_regex(p) is None for p in pattern.split("/"))


def normalised(path: Column) -> Column:
    return F.concat(F.array_join(F.filter(F.split(path, "/"), lambda s: s != ""), "/"), F.when(path.rlike("[^/]"), F.lit("/")).otherwise(F.lit("")))


def base(path: Column) -> Column:
    """The last non-empty segment; ``.`` for an empty path and ``/`` for slashes only."""
    name = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.when(path == "", ".").when(name == "", "/").otherwise(name)


def match_path(path: Column, pattern: str) -> Column:
    r = segments_regex(pattern)
    return F.lit(False) if r is None else normalised(path).rlike(f"^(?s:{r})$(?!\\n)")


def matches_any(path: Column, patterns: list[str]) -> Column:
    """True if the path, its base name or its segments match one of the globs."""
    out = F.lit(False)
    for p in patterns:
        r = fnmatch_regex(p)
        if r is not None:
            out = out | path.rlike(f"^(?s:{r})\\z") | base(path).rlike(f"^(?s:{r})\\z")
        s = segments_regex(p)
        if s is not None:
            out = out | normalised(path).rlike(f"^(?s:{s})\\z")
    return out


def ext_lower(path: Column) -> Column:
    """From the base name's last dot on, in lower case (``.bashrc`` is its own extension)."""
    return F.lower(F.regexp_extract(base(path), r"(\.[^.]*)$", 1))


def ext_of(path: Column) -> Column:
    """As ``ext_lower``, but a leading dot makes no extension."""
    return F.lower(F.regexp_extract(base(path), r"^.+(\.[^.]*)$", 1))


def has_extension(path: Column, extensions: list[str]) -> Column:
    """The extension is listed (case doesn't matter); ``dockerfile`` stands for its three name forms."""
    low = F.lower(base(path))
    plain = sorted({e.lower() for e in extensions} - {"dockerfile"})
    dotted = [e if e.startswith(".") else "." + e for e in plain]
    out = ext_lower(path).isin(dotted) if dotted else F.lit(False)
    if any(e.lower() == "dockerfile" for e in extensions):
        out = out | low.rlike(r"^(dockerfile|dockerfile\..*|.*\.dockerfile)$")
    return out


def first_match(path: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The value of the first (glob, value) rule that matches."""
    out = None
    for pattern, value in rules:
        cond = matches_any(path, [pattern])
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return F.lit(default) if out is None else out.otherwise(default)


def python_match(pattern: str, name: str) -> bool:
    """The same glob on the driver, for configuration."""
    r = fnmatch_regex(pattern)
    return r is not None and re.fullmatch(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", r), name, re.S) is not None
