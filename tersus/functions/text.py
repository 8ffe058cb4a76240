"""String helpers (V3 strip, V4 title case, replacement-syntax translation)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as a Python str.strip() sees it: Unicode white space plus the
# ASCII information separators \x1c-\x1f.
_WS = r"[\s\x{1c}-\x{1f}]"
_STRIP = rf"(?U)^{_WS}+|{_WS}+$"


def strip_ws(c: Column) -> Column:
    """Strip leading/trailing white space, tabs and newlines included (F.trim strips spaces only)."""
    return F.regexp_replace(c, _STRIP, "")


def title_case(c: Column) -> Column:
    """Title case with str.title() semantics: a cased run starts upper, continues lower.

    Split into alternating letter / non-letter runs, capitalise each letter run,
    join back. ``initcap`` alone would treat "o'neil" as one word.
    """
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.when(c.isNotNull(), F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))),
        ""))


#: Escapes of a Python replacement that stand for one character.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "b": "\b"}


def python_replacement_to_java(repl: str) -> str:
    """Translate a Python ``re.sub`` replacement (\\1, \\g<1>, \\g<name>) to Java's ($1, ${name})."""
    out = []
    i = 0
    while i < len(repl):
        ch = repl[i]
        if ch == "$":
            out.append("\\$")
        elif ch == "\\" and i + 1 < len(repl):
            nxt = repl[i + 1]
            if nxt.isdigit():
                out.append("$" + nxt)
                i += 1
            elif nxt == "g":
                m = re.match(r"\\g<(\w+)>", repl[i:])
                if m:
                    g = m.group(1)
                    out.append("$" + g if g.isdigit() else "${" + g + "}")
                    i += len(m.group(0)) - 1
                else:
                    out.append("\\\\g")
                    i += 1
            elif nxt == "\\":
                out.append("\\\\")
                i += 1
            elif nxt in _ESCAPES:
                out.append(_ESCAPES[nxt])
                i += 1
            else:
                out.append(nxt)
                i += 1
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def python_pattern_to_java(pattern: str) -> str:
    """Translate Python-only regex syntax to Java's: named groups ``(?P<n>...)``, back-references ``(?P=n)``, the
    end of text ``\\Z``, and Unicode classes (``\\w`` matches any letter). Both read the rest the same way."""
    pattern = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)
    pattern = re.sub(r"((?:^|[^\\])(?:\\\\)*)\\Z", r"\1\\z", pattern)
    return "(?U)" + pattern
