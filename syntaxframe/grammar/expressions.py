"""Expression rules from a table of operators by level."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from ..errors import GrammarError
from .dsl import Grammar, Ladder, choice, field, prec, prec_left, prec_right, ref, seq
from .ir import Expr

Operators = Mapping[str, Iterable[str]]
Postfix = Mapping[str, tuple[str, Callable[[Expr], Expr]]]


def expression(
    g: Grammar,
    name: str,
    *,
    primary: Iterable[str],
    ladder: Ladder,
    infix: Operators | None = None,
    right: Operators | None = None,
    prefix: Operators | None = None,
    postfix: Postfix | None = None,
    cond_primary: str | None = None,
    cond_drops: Iterable[str] = (),
) -> Expr:
    """Adds ``name`` (hidden in the tree as a supertype) with binary, unary and postfix forms; returns a reference.

    infix levels associate to the left, right levels to the right; a postfix level gives (rule name, builder over the operand).
    cond_primary names a second rule without the postfix levels in cond_drops, for conditions before a block.
    """
    infix, right, prefix, postfix = infix or {}, right or {}, prefix or {}, postfix or {}
    for level in (*infix, *right, *prefix, *postfix, *cond_drops):
        ladder.n(level)
    for level in postfix:
        if any(ladder.n(level) < ladder.n(other) for other in prefix):
            raise GrammarError(f"postfix level {level!r} must be tighter than prefix levels")
    if missing := set(cond_drops) - set(postfix):
        raise GrammarError(f"cond_drops names no postfix level: {sorted(missing)}")

    def forms(self_name: str, suffix: str, dropped: frozenset[str]) -> list[str]:
        e, made = ref(self_name), list(primary)
        operators = lambda ops: field("operator", choice(*ops) if len(tuple(ops)) > 1 else next(iter(ops)))
        binary = [prec_left(ladder.n(v), seq(field("left", e), operators(ops), field("right", e))) for v, ops in infix.items()]
        binary += [prec_right(ladder.n(v), seq(field("left", e), operators(ops), field("right", e))) for v, ops in right.items()]
        if binary:
            g.rule(f"binary{suffix}", choice(*binary))
            made.append(f"binary{suffix}")
        if prefix:
            g.rule(f"unary{suffix}", choice(*(prec(ladder.n(v), seq(operators(ops), field("operand", e))) for v, ops in prefix.items())))
            made.append(f"unary{suffix}")
        for level, (rule, build) in postfix.items():
            if level not in dropped:
                g.rule(f"{rule}{suffix}", prec_left(ladder.n(level), build(e)))
                made.append(f"{rule}{suffix}")
        return made

    g.rule(name, choice(*map(ref, forms(name, "", frozenset()))), supertype=True)
    if cond_primary:
        g.rule(cond_primary, choice(*map(ref, forms(cond_primary, "_cond", frozenset(cond_drops)))), supertype=True)
    return ref(name)


#: Cases that pin what an operator table means: (source, compact form of the first expression), for tables with a power level to the
#: right and tighter than prefixes, and names and numbers as leaves.
SMOKE = (
    ("1 + 2 * 3;", "((number) + ((number) * (number)))"),
    ("1 * 2 + 3;", "(((number) * (number)) + (number))"),
    ("1 - 2 - 3;", "(((number) - (number)) - (number))"),
    ("-x * 7;", "((- (identifier)) * (number))"),
    ("2 ^ 3 ^ 4;", "((number) ^ ((number) ^ (number)))"),
    ("p or q * 2;", "((identifier) or ((identifier) * (number)))"),
    ("x - y * z ^ 2;", "((identifier) - ((identifier) * ((identifier) ^ (number))))"),
    ("g(2) + 1;", "(((identifier) ( (number) )) + (number))"),
)


def semantic_smoke(
    parse: Callable[[str], object], expected: Iterable[tuple[str, str]] | None = None, render: Callable[[object], str] | None = None
) -> list[tuple[str, str, str]]:
    """(source, expected, got) of the cases whose tree is not the expected one. Without cases SMOKE; without a form the compact one of
    the first expression, which is looked for below the first statement."""
    if render is None:
        from ..operators.render import render_compact

        def render(root: object) -> str:
            shown = ("binary", "unary", "parenthesized", "call", "identifier", "number")
            found = next((n for n in root.walk() if n.kind in shown), None)
            return "" if found is None else render_compact(found)

    return [(source, want, got) for source, want in (SMOKE if expected is None else expected) if (got := render(parse(source))) != want]
