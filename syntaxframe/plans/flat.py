"""Grammars that are lists of tokens, parsed in the JVM.

A grammar is flat if its tree is a root over any number of tokens, each by itself or alone in a node, and if every character begins some
token, so that no text has an error. Such a grammar is one regular expression, whose alternatives are the tokens in the order in
which the lexer prefers them. The nodes relation then is a column expression over the text (matches, and running sums of their
sizes), without a Python worker. Everything here must give the very rows of parse.rows; what it cannot is left to the parser.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grammar.tables import END, Tables, Terminal
from ..parse.rows import ARROW, CHILD, PAIR, Wanted

#: Members of a class in the parser's language, as the JVM says it (white space: fixed values). The two may know different versions of
#: Unicode, so the JVM is asked for the characters that it lacks.
_SETS = {"w": r"\p{L}\p{N}_", "d": r"\p{Nd}", "s": r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"}
_CONTROLS = {"n": r"\n", "t": r"\t", "r": r"\r", "f": r"\f", "v": r"\x0B"}
#: Matches whose sizes are summed in one step.
BLOCK = 64


class _Unknown(Exception):
    """Something that is not translated."""


def _plain(ch: str) -> str:
    return ch if ch.isalnum() or ord(ch) > 127 or ch in "_ " else f"\\x{ord(ch):02X}"


@lru_cache(maxsize=8)
def jvm_sets(spark: SparkSession) -> dict[str, str]:
    """Members of the classes, whole, for this session's JVM."""
    out, pattern = {}, spark._jvm.java.util.regex.Pattern
    for k, members in _SETS.items():
        own, others = ("".join(re.findall(f"\\{c}", _every_character())) for c in (k, k.upper()))
        lacks, more = pattern.compile(f"[{members}]").matcher(own).replaceAll(""), pattern.compile(f"[^{members}]").matcher(others).replaceAll("")
        if more:
            raise RuntimeError(f"the JVM counts characters to \\{k} that the parser does not")
        ranges: list[list[int]] = []
        for c in sorted(map(ord, lacks)):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
        more = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
        # One comparison for most characters, before the many.
        out[k] = members + (f"[\\x{{{ranges[0][0]:X}}}-\\x{{{ranges[-1][1]:X}}}&&[{more}]]" if ranges else "")
    return out


def _class(pattern: str, at: int, sets: dict[str, str]) -> tuple[str, int]:
    """The class that opens at a place, for the JVM, and the place behind it."""
    at += 1
    negated = pattern[at] == "^"
    at += negated
    items, without, first = "", [], True
    while first or pattern[at] != "]":
        first, ch = False, pattern[at]
        if ch == "\\":
            ch, at = pattern[at + 1], at + 2
            if ch in sets:
                items += sets[ch]
            elif ch.lower() in sets:
                without.append(sets[ch.lower()])
            elif ch in _CONTROLS:
                items += _CONTROLS[ch]
            elif ch.isalnum():
                raise _Unknown
            else:
                items += _plain(ch)
            continue
        at += 1
        # A range's dash stands between two members, any other is escaped.
        if ch == "-" and items and pattern[at] != "]":
            items += "-"
        else:
            items += _plain(ch)
    at += 1
    if len(without) > 1:
        raise _Unknown
    if not without:
        return f"[{'^' * negated}{items}]", at
    if negated:
        return f"[{without[0]}&&[^{items}]]" if items else f"[{without[0]}]", at
    return f"[{items}[^{without[0]}]]", at


def for_jvm(pattern: str, sets: dict[str, str] = _SETS) -> str:
    """A token's pattern for the JVM's regular expressions. Raises _Unknown for what may mean something else there, or go deep."""
    out, at = "", 0
    while at < len(pattern):
        ch = pattern[at]
        if ch == "[":
            part, at = _class(pattern, at, sets)
            out += part
        elif ch == "\\":
            ch, at = pattern[at + 1], at + 2
            if ch in sets:
                out += f"[{sets[ch]}]"
            elif ch.lower() in sets:
                out += f"[^{sets[ch.lower()]}]"
            elif ch in _CONTROLS:
                out += _CONTROLS[ch]
            elif ch.isalnum():
                raise _Unknown
            else:
                out += _plain(ch)
        elif ch == "(":
            opens = next((o for o in ("(?:", "(?=", "(?!") if pattern.startswith(o, at)), None)
            if opens is None and pattern.startswith("(?", at):
                raise _Unknown
            out, at = out + (opens or "(?:"), at + len(opens or "(")
        elif ch in "^$":
            raise _Unknown
        elif ch == ".":
            out, at = out + r"[^\n]", at + 1
        elif ch in ")|*+?":
            out, at = out + ch, at + 1
        elif ch == "{":
            end = pattern.index("}", at) + 1 if "}" in pattern[at:] else 0
            if not re.fullmatch(r"\{\d+(,\d*)?\}", pattern[at:end]):
                raise _Unknown
            out, at = out + pattern[at:end], end
        else:
            out, at = out + _plain(ch), at + 1
    # Nothing follows a last group, so its turns need not be taken back; the JVM then counts them without going deeper.
    out = re.sub(r"\)([+*])(\)*)$", r")\1+\2", out)
    if re.search(r"\)[+*](?![+])", out):
        raise _Unknown
    return out


@lru_cache(maxsize=1)
def _every_character() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))


_ONE = re.compile(r"\(\?:(\[\^?(?:\\.|[^\]\\])+\]|\\[wWsSdD])(\+?)\)")


def _single(t: Terminal) -> tuple[str, bool] | None:
    """(pattern of one character, does it repeat?) of a token that is one character or a run of them."""
    if t.literal is not None:
        return (re.escape(t.literal), False) if len(t.literal) == 1 else None
    found = _ONE.fullmatch(t.regex)
    return (found[1], bool(found[2])) if found else None


def _overlap(a: str, b: str) -> bool:
    return bool(re.search(b, "".join(re.findall(a, _every_character()))))


@dataclass(frozen=True)
class Flat:
    """root: kind of the root. tokens: terminals in the order in which they are tried. wrappers: token -> (kind, field) of the node that it is
    alone in."""

    root: str
    tokens: tuple[Terminal, ...]
    wrappers: dict[str, tuple[str, str | None]]

    @property
    def long(self) -> bool:
        """Are some tokens runs of all characters but a few? Places are worked out here only then: of many short tokens the parser does
        it faster."""
        return any(t.literal is None and (one := _single(t)) is not None and one[1] and one[0].startswith("[^") and "\\" + "W" not in one[0] for t in self.tokens)

    def regex(self, spark: SparkSession) -> str:
        """All tokens, one group each."""
        return "|".join(f"({for_jvm(t.regex, jvm_sets(spark))})" for t in self.tokens)


def _shape(tables: Tables) -> tuple[str, dict[str, tuple[str, str | None]]] | None:
    """The root and the wrappers, if the productions are those of a list of tokens."""
    by_head: dict[str, list] = {}
    for p in tables.productions:
        by_head.setdefault(p.head, []).append(p)
    root = by_head["~start"][0].steps[0].symbol
    inner = [p for p in by_head.pop(root, []) if p.steps]
    by_head.pop("~start")
    if len(inner) != 1 or len(inner[0].steps) != 1 or inner[0].steps[0].field or inner[0].steps[0].alias or not any(not p.steps for p in tables.productions if p.head == root):
        return None
    items = inner[0].steps[0].symbol
    if items not in tables.hidden:
        return None
    members = set()
    for p in by_head.pop(items, []):
        steps = p.steps[1:] if len(p.steps) == 2 and p.steps[0].symbol == items else p.steps
        if len(steps) != 1 or any(s.field or s.alias for s in p.steps):
            return None
        members.add(steps[0].symbol)
    wrappers = {}
    for head, found in by_head.items():
        one = found[0].steps
        if len(found) != 1 or len(one) != 1 or one[0].alias or head in tables.hidden or head in tables.supertypes or head not in members or one[0].symbol not in tables.terminals or one[0].symbol in members:
            return None
        wrappers[one[0].symbol] = head, one[0].field
    if {*members, *wrappers} - set(by_head) - set(tables.terminals):
        return None
    return root, wrappers


def flat(tables: Tables) -> Flat | None:
    """The grammar as a list of tokens, or None if it is not one."""
    if tables.externals or tables.extra_rules or tables.word or any(tables.reserved.values()) or tables.forking:
        return None
    shape = _shape(tables)
    tokens = [t for t in tables.terminals.values() if t.name != END]
    if shape is None or any(t.immediate or t.external or t.regex is None or (t.extra and t.kind) for t in tokens):
        return None
    singles = {t.name: _single(t) for t in tokens}
    left = _every_character()
    for one in singles.values():
        if one is not None:
            left = re.sub(one[0], "", left)
    if left:
        return None
    # Higher precedence first; of equal ones the longest, which an order can only say of single characters.
    tokens.sort(key=lambda t: (-t.prec, t.literal is None))
    for k, t in enumerate(tokens):
        for other in tokens[k + 1 :]:
            if other.prec == t.prec:
                a, b = singles[t.name], singles[other.name]
                if a is None or b is None or (a[1] or b[1]) and _overlap(a[0], b[0]):
                    return None
    try:
        for t in tokens:
            for_jvm(t.regex)
    except (_Unknown, IndexError):
        return None
    return Flat(shape[0], tuple(tokens), shape[1])


def running(df: DataFrame, name: str, values: str, step: Callable[[Column, Column], Column]) -> DataFrame:
    """df with an array column: what the values of another come to before each of them, and at the end of all. Blocks first, then the
    blocks' ends: arrays are never extended value by value over the whole length."""
    zero = F.array(F.lit(0).cast("long"))
    along = lambda x, of=lambda v: v: F.aggregate(x, zero, lambda acc, v: F.concat(acc, F.array(step(F.element_at(acc, -1), of(v)))))
    # By places: slice() would go over the whole array for each block.
    last = F.size(values) - 1
    blocks = F.transform(F.sequence(F.lit(0), last, F.lit(BLOCK)), lambda at: along(F.sequence(at, F.least(at + BLOCK - 1, last)), lambda k: F.get(values, k)))
    df = df.withColumn("_blocks", blocks)
    df = df.withColumn("_ends", along(F.transform("_blocks", lambda b: F.element_at(b, -1))))
    whole = F.flatten(F.transform("_blocks", lambda b, k: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda v: step(F.get("_ends", k), v))))
    return df.withColumn(name, F.concat(whole, F.array(F.element_at("_ends", -1)))).drop("_blocks", "_ends")


def serves(grammar: Flat | None, want: Wanted) -> bool:
    """Can the rows that a plan wants be made here?"""
    if grammar is None or want.kinds is None or want.pair_kinds or grammar.root in want.kinds or want.places and not grammar.long:
        return False
    kinds = {t.kind for t in grammar.tokens} | {k for k, _ in grammar.wrappers.values()}
    return not kinds & set(want.wrappers)


def _only_kinds(docs: DataFrame, grammar: Flat, want: Wanted, carried: list[str]) -> DataFrame:
    """Rows without numbers and places: each kind by one pass over the text."""
    pattern, found = F.lit(grammar.regex(docs.sparkSession)), []
    for k, t in enumerate(grammar.tokens):
        wrapper = grammar.wrappers.get(t.name)
        path = f"/{grammar.root}"
        nodes = [(t.kind, t.named, path if wrapper is None else f"{path}/{wrapper[0]}", True)] + ([] if wrapper is None else [(wrapper[0], True, path, False)])
        for kind, named, above, leaf in nodes:
            if kind is None or kind not in want.kinds:
                continue
            keep = leaf if want.text is None else kind in want.text
            texts = F.filter(F.regexp_extract_all("text", pattern, F.lit(k + 1)), lambda x: x != "")
            known = {"kind": F.lit(kind), "named": F.lit(named), "path": F.lit(above), "is_error": F.lit(False), "is_missing": F.lit(False), "extra": F.lit(False)}
            row = lambda x: F.struct(*(known.get(n, x if n == "text" and keep else F.lit(None)).cast(_TYPES[n]).alias(n) for n, _ in ARROW))  # noqa: B023, E731
            found.append(F.transform(texts, row))
    if not found:
        return docs.where("false").select(*carried, *(F.lit(None).cast(_TYPES[n]).alias(n) for n, _ in ARROW))
    return docs.select(*carried, F.inline(found[0] if len(found) == 1 else F.concat(*found)))


def flat_nodes(docs: DataFrame, grammar: Flat, want: Wanted, carried: list[str]) -> DataFrame:
    """The nodes relation of docs(carried..., text) for what a plan wants, by expressions only."""
    counts = {t.name: 0 if t.kind is None else 2 if t.name in grammar.wrappers else 1 for t in grammar.tokens}
    usual = max(counts.values(), key=list(counts.values()).count)
    if not want.places:
        return _only_kinds(docs, grammar, want, carried)
    wanted = [t for t in grammar.tokens if t.kind is not None and (t.kind in want.kinds or grammar.wrappers.get(t.name, ("",))[0] in want.kinds)]
    pattern = F.lit(grammar.regex(docs.sparkSession))
    group = {t.name: k + 1 for k, t in enumerate(grammar.tokens)}
    literals = {t.name: t.literal for t in grammar.tokens if t.literal is not None}
    # A literal is known by its text; and so is one other token, if there is no third.
    others = [t.name for t in grammar.tokens if t.name not in literals]
    by_text = literals and len(others) == 1
    # Line breaks that each match of a token has, where they are as many in all.
    breaks = {t.name: t.literal.count("\n") if t.literal is not None else 0 if (one := _single(t)) and not re.search(one[0], "\n") else None for t in grammar.tokens}
    marked = {t.name for t in wanted} | {n for n, c in counts.items() if c != usual} | ({n for n, c in breaks.items() if c} if None not in breaks.values() else set())
    df = docs.withColumn("_all", F.regexp_extract_all("text", pattern, F.lit(0)))
    df = df.where(F.size("_all") > 0)
    for n in () if by_text else marked:
        df = df.withColumn(f"_g{group[n]}", F.regexp_extract_all("text", pattern, F.lit(group[n])))

    def is_(n: str, at: Column) -> Column:
        if not by_text:
            return F.get(f"_g{group[n]}", at) != ""
        return F.get("_all", at) == literals[n] if n in literals else ~F.get("_all", at).isin(*literals.values())

    places = F.sequence(F.lit(0), F.size("_all") - 1)

    def of_token(values: dict[str, int]) -> Column:
        odd = {n: v for n, v in values.items() if n in marked}
        rest = next((v for n, v in values.items() if n not in marked), 0)

        def one(at: Column) -> Column:
            out = F.lit(rest).cast("long")
            for n, v in odd.items():
                out = F.when(is_(n, at), F.lit(v).cast("long")).otherwise(out)
            return out

        return F.transform(places, one)

    tail = lambda x: F.substring_index(x, "\n", -1)
    counted = F.transform("_all", lambda x: (F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))).cast("long")) if None in breaks.values() else of_token(breaks)
    df = df.withColumns({"_bytes": F.transform("_all", lambda x: F.octet_length(x).cast("long")), "_lines": counted})
    add = lambda a, b: a + b
    df = running(df, "_end", "_bytes", add)
    df = running(df, "_row", "_lines", add)
    df = df.withColumn("_head", F.transform("_all", lambda x, k: F.when(F.get("_lines", k) > 0, F.get("_end", k + 1) - F.octet_length(tail(x))).otherwise(F.lit(0)).cast("long")))
    df = running(df, "_line", "_head", lambda a, b: F.greatest(a, b))
    if len(set(counts.values())) == 1:
        df = df.withColumns({"_id": F.transform(F.sequence(F.lit(0), F.size("_all")), lambda k: (k * usual).cast("long")), "_child": F.transform(F.sequence(F.lit(0), F.size("_all")), lambda k: k.cast("long"))})
    else:
        df = df.withColumns({"_count": of_token(counts), "_seen": of_token({n: min(c, 1) for n, c in counts.items()})})
        df = running(running(df, "_id", "_count", add), "_child", "_seen", add)

    integer = lambda name, at, more=0: (F.get(name, at) + more).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    child, pair = f"array<struct<{CHILD}>>", f"array<struct<{PAIR}>>"

    def row(t: Terminal, at: Column, kind: str, named: bool, inner: bool) -> Column:
        """A row of the token itself, or of the node that it is alone in."""
        wrapper = grammar.wrappers.get(t.name)
        outer = wrapper is not None and not inner
        deep = wrapper is not None and inner
        text = F.get("_all", at)
        keep = not outer if want.text is None else kind in want.text
        kids = F.array().cast(child)
        if outer:
            kids = F.array(
                F.struct(
                    F.lit(0).alias("idx"), integer("_id", at, 2).alias("node_id"), F.lit(wrapper[1]).cast("string").alias("field"), F.lit(t.kind).alias("kind"), F.lit(t.named).alias("named"),
                    F.lit(False).alias("extra"), F.lit(False).alias("missing"), integer("_end", at).alias("start_byte"), integer("_end", at + 1).alias("end_byte"), text.alias("text"),
                    none("array<struct<node_id int, text string>>").alias("inner"),
                )
            ).cast(child)
        parts = {
            "node_id": integer("_id", at, 2 if deep else 1), "last_id": integer("_id", at, 1 if wrapper is None else 2), "parent_id": integer("_id", at, 1) if deep else F.lit(0),
            "depth": F.lit(2 if deep else 1), "child_idx": F.lit(0) if deep else integer("_child", at), "field": F.lit(wrapper[1] if deep else None).cast("string"), "kind": F.lit(kind),
            "named": F.lit(named), "extra": F.lit(False), "is_error": F.lit(False), "is_missing": F.lit(False), "start_byte": integer("_end", at), "end_byte": integer("_end", at + 1),
            "start_row": integer("_row", at), "start_col": (F.get("_end", at) - F.get("_line", at)).cast("int"), "end_row": integer("_row", at + 1),
            "end_col": (F.get("_end", at + 1) - F.get("_line", at + 1)).cast("int"), "path": F.lit(f"/{grammar.root}" + (f"/{wrapper[0]}" if deep else "")),
            "text": text if keep else none("string"), "children": kids if want.children else none(child), "pairs": none(pair),
        }
        return F.struct(*(parts[n].alias(n) for n, _ in ARROW))

    found = []
    for t in wanted:
        mine = F.filter(places, lambda at: is_(t.name, at))  # noqa: B023
        wrapper = grammar.wrappers.get(t.name)
        if wrapper is not None and wrapper[0] in want.kinds:
            found.append(F.transform(mine, lambda at: row(t, at, wrapper[0], True, False)))  # noqa: B023
        if t.kind in want.kinds:
            found.append(F.transform(mine, lambda at: row(t, at, t.kind, t.named, True)))  # noqa: B023
    if not found:
        return df.where("false").select(*carried, *(none(_TYPES[n]).alias(n) for n, _ in ARROW))
    return df.select(*carried, F.inline(found[0] if len(found) == 1 else F.concat(*found)))


_TYPES = {n: f"array<struct<{CHILD}>>" if n == "children" else f"array<struct<{PAIR}>>" if n == "pairs" else {"int32": "int", "string": "string", "bool": "boolean"}[str(t)] for n, t in ARROW}
