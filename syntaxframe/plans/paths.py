"""Ancestor paths as predicates on the ``path`` column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import GAP, M


def path_regex(path: M) -> str | None:
    """A regular expression that the ancestors' path ends with, or None if any ancestors do.

    A step is one segment, a gap any number of them.
    """
    above = path.steps[:-1]
    if not above:
        return None
    parts = ["(?:/[^/]+)*" if s == GAP else "/(?:" + "|".join(map(re.escape, s)) + ")" for s in above]
    return "".join(parts) + "$"


def selected(path: M) -> Column:
    """Is a row of nodes an anchor of this path?"""
    test = F.col("kind").isin(*path.anchors) & F.col("named")
    regex = path_regex(path)
    return test if regex is None else test & F.col("path").rlike(regex)


def matches_chain(chain: list[str], path: M) -> bool:
    """The same on a list of kinds, root first, the anchor last; for tests and diagnostics."""
    regex = path_regex(path)
    return chain[-1] in path.anchors and (regex is None or re.search(regex, "".join(f"/{k}" for k in chain[:-1])) is not None)
