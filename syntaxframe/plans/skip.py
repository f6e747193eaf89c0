"""Texts that cannot give a row are left out before they are parsed.

A captured text is a stretch of its document, copied as it stands. So where a capture that a row needs has to equal a value, be one of several,
or match a pattern with a fixed part, a document without that value or part gives no row, and no failure either. The test is an ordinary
column expression below the parse: Spark evaluates it while it reads, and hands it to sources that can use it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import AnyOf, Binding, Eq, Matches
from .analyze import Checked

#: Escapes in a pattern that stand for one of several characters or for none; after any other letter or digit nothing is said.
_CLASSES = "dDwWsSbBhHvVRAzZG"


def fixed_part(pattern: str) -> str | None:
    """The longest text that every match of a pattern contains, as far as this looks: literal characters outside groups and classes. None where
    there is none or the pattern has anything that this does not know."""
    if "(?" in pattern.replace("(?:", "").replace("(?=", "").replace("(?!", "").replace("(?<=", "").replace("(?<!", "") or "\\Q" in pattern:
        return None
    runs, run, at, size = [""], "", 0, len(pattern)

    def cut() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    while at is not None and at < size:
        ch = pattern[at]
        if ch == "|":
            return None
        if ch in "([":
            cut()
            at = _closed(pattern, at)
            at = None if at is None else _quantified(pattern, at)
            continue
        if ch in "^$.":
            cut()
            at = _quantified(pattern, at + 1)
            continue
        if ch in ")]}{*+?":
            return None
        step = 1
        if ch == "\\":
            if at + 1 == size:
                return None
            ch, step = pattern[at + 1], 2
            if ch in "pP" and pattern[at + 2 : at + 3] == "{" and "}" in pattern[at:]:
                cut()
                at = _quantified(pattern, pattern.index("}", at) + 1)
                continue
            if ch in _CLASSES:
                cut()
                at = _quantified(pattern, at + 2)
                continue
            if ch.isalnum():
                return None
        after = at + step
        if pattern[after : after + 1] in ("?", "*", "{"):
            cut()
            at = _quantified(pattern, after)
        else:
            run += ch
            at = after
            if pattern[at : at + 1] == "+":
                cut()
                at = _quantified(pattern, at)
    if at is None:
        return None
    cut()
    return max(runs, key=len) or None


def _closed(pattern: str, at: int) -> int | None:
    """The place behind the group or class that opens at a place."""
    depth, inside = 0, False
    while at < len(pattern):
        ch = pattern[at]
        if ch == "\\":
            at += 2
            continue
        if inside:
            # A class within a class, or a bracket as its first member: nothing is said about these.
            if ch == "[" or ch == "]" and pattern[at - 1] in "[^":
                return None
            inside = ch != "]"
        elif ch == "[":
            inside = True
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        at += 1
        if not depth and not inside:
            return at
    return None


def _quantified(pattern: str, at: int) -> int | None:
    """The place behind a quantifier, if there is one."""
    if pattern[at : at + 1] == "{":
        end = pattern.find("}", at)
        if end < 0:
            return None
        at = end + 1
    elif pattern[at : at + 1] in ("?", "*", "+"):
        at += 1
    else:
        return at
    return at + (pattern[at : at + 1] in ("?", "+"))


def _needed(b: Binding, text: Column) -> list[Column]:
    """What a text must contain for a binding's predicates to hold."""
    out = []
    for p in b.predicates:
        values = [p.value] if isinstance(p, Eq) else list(p.values) if isinstance(p, AnyOf) else [fixed_part(p.regex)] if isinstance(p, Matches) else [None]
        if values and all(values):
            out.append(reduce(lambda a, c: a | c, [text.contains(F.lit(v)) for v in values]))
    return out


def can_give_rows(checked: Checked, text: Column) -> Column | None:
    """A test that every text with a row or a failure passes; None where nothing can be said."""
    if checked.spec.raw is not None:
        return None
    needed = [c for b in checked.spec.captures if b.required and b.nested is None and not b.unescape for c in _needed(b, text)]
    return reduce(lambda a, c: a & c, needed) if needed else None


def any_can_give_rows(models: list[Checked], text: Column) -> Column | None:
    """The same for several models over one parse: None where one of them may need any text."""
    tests = [can_give_rows(c, text) for c in models]
    return None if not tests or any(t is None for t in tests) else reduce(lambda a, c: a | c, tests)
