"""Path helpers (H3, H4, B8) and glob translation.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen.  Paths are absolute, ``/``-separated, without a trailing slash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_name(path="path") -> Column:
    """H3: last path component."""
    return F.substring_index(_c(path), "/", -1)


def parent_dir(path="path") -> Column:
    """H4: the path without its last component."""
    return F.regexp_replace(_c(path), "/[^/]*$", "")


def path_parts(path="path") -> Column:
    """``/home/u1/f`` -> ``['', 'home', 'u1', 'f']`` (index 1 is the empty root)."""
    return F.split(_c(path), "/")


def root_len(root: str) -> int:
    """Number of parts of a root path, counted as :func:`path_parts` counts them."""
    return len(root.rstrip("/").split("/"))


def depth_below(root: str, path="path") -> Column:
    """Number of components of ``path`` below ``root`` (a direct child is 1)."""
    return F.size(path_parts(path)) - F.lit(root_len(root))


def below(root: str, path="path") -> Column:
    """A1/B5 test: ``path`` lies strictly below ``root``."""
    return _c(path).startswith(root.rstrip("/") + "/")


def at_or_below(root: str, path="path") -> Column:
    r = root.rstrip("/")
    return (_c(path) == F.lit(r)) | _c(path).startswith(r + "/")


# ---------------------------------------------------------------------------
# Glob translation.  ``find -name`` / ``-path`` use fnmatch without
# FNM_PATHNAME or FNM_PERIOD: ``*`` matches any run of characters (``/`` and a
# leading dot included), ``?`` one character, ``[...]`` a class.
# ---------------------------------------------------------------------------

_WILD = re.compile(r"[*?\[\\]")


def glob_body(glob: str) -> str:
    """Regex body (Java and RE2) for one glob; needs ``(?s)``, as names may
    hold newlines."""
    out, i, n = [], 0, len(glob)
    while i < n:
        ch = glob[i]
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "\\" and i + 1 < n:
            i += 1
            out.append(re.escape(glob[i]))
        elif ch == "[":
            j = glob.find("]", i + 2 if i + 1 < n and glob[i + 1] in "!^" else i + 1)
            if j < 0:
                out.append(re.escape(ch))
            else:
                body = glob[i + 1:j]
                if body[:1] in ("!", "^"):
                    body = "^" + body[1:]
                out.append("[" + body.replace("\\", "\\\\") + "]")
                i = j
        else:
            out.append(re.escape(ch) if not ch.isalnum() else ch)
        i += 1
    return "".join(out)


def whole(body: str) -> str:
    """The pattern for a whole value: ``.`` takes newlines too, and the end is
    the end of the value, not a newline before it."""
    return r"(?s)\A(?:" + body + r")\z"


def glob_to_regex(glob: str) -> str:
    return whole(glob_body(glob))


def glob_literal(glob: str) -> str | None:
    """The longest text that every match of the glob holds as it stands; None where the
    glob has a class or an escape, or no such text."""
    if "[" in glob or "\\" in glob:
        return None
    return max(re.split(r"[*?]+", glob), key=len) or None


def glob_to_like(glob: str) -> str | None:
    """LIKE pattern with ``\\`` as escape, or None when the glob has a class."""
    if "[" in glob:
        return None
    out = []
    i = 0
    while i < len(glob):
        ch = glob[i]
        if ch == "\\" and i + 1 < len(glob):
            i += 1
            ch = glob[i]
            out.append("\\" + ch if ch in "%_\\" else ch)
        elif ch == "*":
            out.append("%")
        elif ch == "?":
            out.append("_")
        elif ch in "%_\\":
            out.append("\\" + ch)
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def glob_match(glob: str, value: Column) -> Column:
    """Whole-value glob match, as the cheapest built-in that is exact."""
    if not _WILD.search(glob):
        return value == F.lit(glob)
    body = glob[1:]
    if glob.startswith("*") and not _WILD.search(body):
        return value.endswith(body)
    head = glob[:-1]
    if glob.endswith("*") and not _WILD.search(head):
        return value.startswith(head)
    like = glob_to_like(glob)
    if like is not None:
        return value.like(like)
    return value.rlike(glob_to_regex(glob))
