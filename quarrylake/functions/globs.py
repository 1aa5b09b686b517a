"""Path globs compiled to regular expressions on the driver, and path filters as columns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pieces of a glob; what a piece turns into stands beside it, None where it depends on braces.
PIECES = re.compile(r"(?P<folders>(?:(?<=/)|^)\*\*/)|(?P<deep>\*\*)|(?P<star>\*)|(?P<one>\?)|(?P<set>\[[^\]]+\])|(?P<open>\{)|(?P<close>\})|(?P<comma>,)|(?P<sign>.)", re.DOTALL)
TURNED = {"folders": "(?:.*/)?", "deep": ".*", "star": "[^/]*", "one": "[^/]", "open": "(?:"}


def glob_pattern(glob: str) -> str:
    """The body of a regular expression for ``**``, ``*``, ``?``, ``{a,b}`` and ``[..]``; valid in Java, Python and RE2."""
    depth = 0

    def turn(m: re.Match) -> str:
        nonlocal depth
        kind = m.lastgroup
        if kind == "set":
            body = m[0][1:-1]
            return "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\").replace("[", "\\[") + "]"
        if kind == "open":
            depth += 1
        elif kind == "close" and depth:
            depth -= 1
            return ")"
        elif kind == "comma" and depth:
            return "|"
        return TURNED.get(kind) or re.sub(r"([.+^${}()|\[\]\\*?])", r"\\\1", m[0])

    return PIECES.sub(turn, glob.replace("\\", "/").removeprefix("./"))


def path_regex(glob: str) -> str:
    """A regular expression over whole paths; a glob without a slash matches the last name or the whole path."""
    glob = glob.strip()
    if not glob:
        return r"^\b$"  # nothing
    body = glob_pattern(glob)
    return f"^(?:{body})$" if "/" in glob else f"^(?:.*/)?(?=[^/]*$)(?:{body})$|^(?:{body})$"


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def match_any(path: Column, globs: Iterable[str]) -> Column:
    """The path matches one of the globs; false where there are none."""
    patterns = [path_regex(g) for g in globs]
    return normal_path(path).rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def path_filter(path: Column, wanted: str) -> Column:
    """A glob where it has wild cards, else the path itself, a folder above it or a part of it."""
    wanted = wanted.removeprefix("./")
    if re.search(r"[*?{\[]", wanted):
        return match_any(path, [wanted])
    return (path == wanted) | path.startswith(wanted if wanted.endswith("/") else wanted + "/") | path.contains(wanted)
