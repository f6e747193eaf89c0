"""Text to typed columns. A value that does not fit is null; callers tell it from an absent one by the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"^\s+|\s+$"
_INT = r"^[+-]?\d+(?:_\d+)*(?:\.0+)?$"
_FLOAT = r"^(?:[+-]?(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?|[+-]?(?i:nan|inf|infinity))$"
# Spellings of truth.
TRUE = ("true", "yes", "on", "1", "t", "y")
FALSE = ("false", "no", "off", "0", "f", "n")


def to_int(text: Column) -> Column:
    bare = F.regexp_replace(text, _BLANK, "")
    digits = F.regexp_replace(F.regexp_replace(bare, "_", ""), r"\.0+$", "")
    # Most are digits alone, which need no patterns: what begins and ends with one and casts has nothing else in between.
    plain = F.when(_digit(F.substring(text, 1, 1)) & _digit(F.substring(text, -1, 1)), text.try_cast("long"))
    return F.coalesce(plain, F.when(bare.rlike(_INT), digits.try_cast("long")))


def _digit(ch: Column) -> Column:
    return (ch >= "0") & (ch <= "9")


def to_float(text: Column) -> Column:
    bare = F.regexp_replace(text, _BLANK, "")
    return F.when(bare.rlike(_FLOAT), F.regexp_replace(bare, "_", "").try_cast("double"))


def to_bool(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin(*TRUE), F.lit(True)).when(low.isin(*FALSE), F.lit(False))


def to_str(text: Column) -> Column:
    return text


CONVERSIONS = {"str": to_str, "int": to_int, "float": to_float, "bool": to_bool}


def converted(text: Column, targets: tuple[str, ...]) -> Column:
    """The first of several types that a text fits."""
    if len(targets) == 1:
        return CONVERSIONS[targets[0]](text)
    if "float" in targets:
        return to_float(text)
    return F.coalesce(*(CONVERSIONS[t](text) for t in targets))


def unescaped(text: Column) -> Column:
    """A string literal (or its bare content) with its escapes decoded; what JSON does not know is decoded by itself."""
    quoted = text.rlike(r'^"(?s:.*)"$') & (F.length(text) >= 2)
    body = F.when(quoted, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    whole = F.from_json(F.concat(F.lit('{"v":"'), body, F.lit('"}')), "v string", {"mode": "PERMISSIVE"})["v"]
    return F.when(~body.contains("\\"), body).otherwise(F.coalesce(whole, by_hand(body)))


#: Escapes decoded when a text is not JSON; any other backslash stays.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "b": "\b", "f": "\f", "/": "/"}


def by_hand(body: Column) -> Column:
    parts = F.regexp_extract_all(body, F.lit(r'(?s)(\\u[0-9A-Fa-f]{4}|\\[ntr"\\bf/]|[^\\]+|\\)'), F.lit(1))

    def one(part: Column) -> Column:
        # A two-byte big-endian code unit, decoded.
        out = F.when(part.rlike(r"^\\u"), F.decode(F.unhex(F.substring(part, 3, 4)), "UTF-16BE"))
        for letter, meant in ESCAPES.items():
            out = out.when(part == "\\" + letter, F.lit(meant))
        return out.otherwise(part)

    return F.array_join(F.transform(parts, one), "")
