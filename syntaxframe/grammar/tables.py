"""Parse tables from a grammar: productions, terminals, LALR(1) states, precedence, declared conflicts.

Rules are expanded into plain productions (choices multiplied out, repeats as left-recursive helpers), terminals are taken out
of rule bodies, and states are built from LR(0) kernels whose lookaheads are propagated to a fixpoint (DeRemer and
Pennello, 1982, give the theory). Conflicts are settled by precedence, then associativity; what is left is an error unless
the grammar declares it, in which case all actions stay and the parser forks.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

from ..errors import GenerateError
from .conflicts import Conflict, GrammarConflictError
from .ir import PRECEDENCES, TOKENS, Expr, GrammarModel

END = "$end"


@dataclass(frozen=True)
class Terminal:
    """A token. ``kind`` is its node kind, or None if it makes no node."""

    name: str
    kind: str | None
    named: bool
    regex: str | None
    literal: str | None
    prec: int = 0
    immediate: bool = False
    external: bool = False
    extra: bool = False


@dataclass(frozen=True)
class Step:
    symbol: str
    field: str | None = None
    alias: str | None = None
    alias_named: bool = False
    reserved: str | None = None


@dataclass(frozen=True)
class Production:
    head: str
    steps: tuple[Step, ...]
    prec: int | str | None = None
    assoc: str | None = None
    dynamic: int = 0


@dataclass
class Tables:
    """All that the parser needs. Plain data, so it can be sent to workers."""

    name: str
    start: str
    terminals: dict[str, Terminal]
    productions: list[Production]
    #: state -> terminal -> actions: ("s", state), ("r", production), ("a",)
    actions: list[dict[str, tuple[tuple, ...]]]
    gotos: list[dict[str, int]]
    extras: tuple[str, ...]
    externals: tuple[str, ...]
    hidden: frozenset[str]
    supertypes: frozenset[str]
    word: str | None
    #: context -> texts that are no words in it
    reserved: dict[str, frozenset[str]]
    forking: bool
    extra_rules: dict[str, Tables] = field(default_factory=dict)
    #: state -> the reserved-word context in which its words are read (None: the grammar's first)
    contexts: list[str | None] = field(default_factory=list)


def regex_of(expr: Expr, rules: dict[str, Expr] | None = None) -> str:
    """A token body as one regular expression."""
    kind = expr.kind
    if kind == "STRING":
        return re.escape(str(expr.value))
    if kind == "PATTERN":
        return f"(?i:{expr.value})" if expr.flags and "i" in expr.flags else f"(?:{expr.value})"
    if kind == "BLANK":
        return ""
    if kind == "SEQ":
        return "".join(regex_of(m, rules) for m in expr.members)
    if kind == "CHOICE":
        return "(?:" + "|".join(sorted((regex_of(m, rules) for m in expr.members), key=lambda r: r == "")) + ")"
    if kind in ("REPEAT", "REPEAT1"):
        return f"(?:{regex_of(expr.content, rules)})" + ("*" if kind == "REPEAT" else "+")
    if kind == "SYMBOL" and rules and expr.name in rules:
        return regex_of(rules[expr.name], rules)
    if kind == "SYMBOL":
        raise GenerateError(f"a token refers to {expr.name}, which is not a token")
    return regex_of(expr.content, rules)


def _token_parts(expr: Expr) -> tuple[Expr, int, bool] | None:
    """(body, lexical precedence, immediate) if the expression is one token, else None."""
    prec, immediate, inside = 0, False, False
    while True:
        if expr.kind in ("STRING", "PATTERN"):
            return expr, prec, immediate
        if expr.kind in PRECEDENCES:
            if isinstance(expr.value, int) and expr.kind != "PREC_DYNAMIC":
                prec = expr.value
            expr = expr.content
        elif expr.kind in TOKENS:
            inside, immediate = True, immediate or expr.kind == "IMMEDIATE_TOKEN"
            expr = expr.content
        elif inside:
            return expr, prec, immediate
        else:
            return None


class _Builder:
    def __init__(self, grammar: GrammarModel):
        self.g = grammar
        self.terminals: dict[str, Terminal] = {}
        self.productions: list[Production] = []
        self.helpers: dict[tuple[str, Expr], str] = {}
        self.hidden = {name for name in grammar.rules if name.startswith("_")} | set(grammar.supertypes)
        self.externals: list[str] = []
        for expr in grammar.externals:
            name = expr.name if expr.kind == "SYMBOL" else str(expr.value)
            self.externals.append(name)
            visible = expr.kind != "SYMBOL" or not name.startswith("_")
            self.terminals[name] = Terminal(name, name if visible else None, expr.kind == "SYMBOL", None, None, external=True)
        self.token_rules = {}
        for name, body in grammar.rules.items():
            parts = _token_parts(body)
            if parts and name != grammar.start and name not in self.terminals:
                self.token_rules[name] = parts
                self._terminal(name, None if name.startswith("_") else name, True, parts)

    def _terminal(self, name: str, kind: str | None, named: bool, parts: tuple[Expr, int, bool]) -> str:
        body, prec, immediate = parts
        literal = str(body.value) if body.kind == "STRING" else None
        self.terminals.setdefault(name, Terminal(name, kind, named, regex_of(body, self.g.rules), literal, prec, immediate))
        return name

    def inline_token(self, expr: Expr) -> str | None:
        parts = _token_parts(expr)
        if parts is None:
            return None
        body, prec, immediate = parts
        if body.kind == "STRING" and str(body.value) in self.externals:
            return str(body.value)
        marks = ("!" if immediate else "") + (f"^{prec}" if prec else "")
        if body.kind == "STRING":
            return self._terminal(f"'{body.value}'{marks}", str(body.value), False, parts)
        return self._terminal(f"/{regex_of(body, self.g.rules)}/{marks}", None, False, parts)

    def expand(self, expr: Expr, head: str, fields=None, alias=None, prec=None, assoc=None, dynamic=0, reserved=None) -> list[tuple]:
        """Alternatives of an expression: (steps, precedence, associativity, dynamic precedence)."""
        kind = expr.kind
        again = lambda e, **k: self.expand(e, head, **{**dict(fields=fields, alias=alias, prec=prec, assoc=assoc, dynamic=dynamic, reserved=reserved), **k})
        if kind == "BLANK":
            return [((), prec, assoc, dynamic)]
        if kind not in PRECEDENCES and (name := self.inline_token(expr)) is not None:
            return [((self._step(name, fields, alias, reserved),), prec, assoc, dynamic)]
        if kind == "SYMBOL":
            if expr.name not in self.g.rules and expr.name not in self.terminals:
                raise GenerateError(f"rule {head} refers to {expr.name}, which is not defined")
            if expr.name in self.g.inline and expr.name not in self.token_rules:
                return again(self.g.rules[expr.name])
            return [((self._step(expr.name, fields, alias, reserved),), prec, assoc, dynamic)]
        if kind == "CHOICE":
            return [a for m in expr.members for a in again(m)]
        if kind == "SEQ":
            out = [((), prec, assoc, dynamic)]
            for m in expr.members:
                out = [(s + t, q if q is not None else p, b or a, max(d, e, key=abs)) for s, p, a, d in out for t, q, b, e in again(m)]
            return out
        if kind in ("REPEAT", "REPEAT1"):
            helper = self.helper(head, expr.content)
            some = [((self._step(helper, fields, None, reserved),), prec, assoc, dynamic)]
            return some + ([((), prec, assoc, dynamic)] if kind == "REPEAT" else [])
        if kind == "FIELD":
            return again(expr.content, fields=expr.name)
        if kind == "ALIAS":
            return again(expr.content, alias=(expr.value, bool(expr.named)))
        if kind == "RESERVED":
            return again(expr.content, reserved=expr.context_name)
        if kind == "PREC_DYNAMIC":
            return again(expr.content, dynamic=expr.value)
        if kind in PRECEDENCES:
            if (name := self.inline_token(expr)) is not None and _token_parts(expr.content) is None:
                return [((self._step(name, fields, alias, reserved),), prec, assoc, dynamic)]
            side = {"PREC": assoc, "PREC_LEFT": "left", "PREC_RIGHT": "right"}[kind]
            return again(expr.content, prec=expr.value, assoc=side)
        if kind in TOKENS:
            raise GenerateError(f"token in {head} cannot be made")
        raise GenerateError(f"{kind} in {head} cannot be expanded")

    def literal_of(self, expr: Expr) -> str | None:
        """The text of a token that is a literal."""
        name = expr.name if expr.kind == "SYMBOL" else self.inline_token(expr)
        return self.terminals[name].literal if name in self.terminals else None

    @staticmethod
    def _step(name, fields, alias, reserved) -> Step:
        return Step(name, fields, *(alias or (None, False)), reserved)

    def helper(self, head: str, content: Expr) -> str:
        """A hidden left-recursive rule for a repeat."""
        base = head.split("~")[0]
        if (base, content) not in self.helpers:
            name = f"{base}~{sum(b == base for b, _ in self.helpers) + 1}"
            self.helpers[base, content] = name
            self.hidden.add(name)
            for steps, prec, assoc, dynamic in self.expand(content, name):
                if steps:
                    self.productions.append(Production(name, steps, prec, assoc, dynamic))
                    self.productions.append(Production(name, (Step(name), *steps), prec, assoc, dynamic))
        return self.helpers[base, content]

    def build(self, start: str) -> None:
        reachable, queue = set(), [start]
        self.productions.append(Production("~start", (Step(start),)))
        bodies = {}
        while queue:
            name = queue.pop()
            if name in reachable or name in self.terminals:
                continue
            reachable.add(name)
            if name not in self.g.rules:
                raise GenerateError(f"{name} is used, but not defined")
            bodies[name] = self.g.rules[name]
            for e in self.g.rules[name].walk():
                if e.kind == "SYMBOL":
                    queue.append(e.name)
        for name, body in self.g.rules.items():
            if name in bodies:
                for steps, prec, assoc, dynamic in dict.fromkeys(self.expand(body, name)):
                    self.productions.append(Production(name, steps, prec, assoc, dynamic))


class _Automaton:
    """LALR(1) states."""

    def __init__(self, productions: list[Production], terminals: dict[str, Terminal]):
        self.productions, self.terminals = productions, terminals
        self.by_head: dict[str, list[int]] = defaultdict(list)
        for i, p in enumerate(productions):
            self.by_head[p.head].append(i)
        self.nullable, self.first = self._first_sets()
        self.kernels: list[dict[tuple[int, int], set[str]]] = []
        self.index: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self._run()

    def _first_sets(self):
        nullable: set[str] = set()
        first: dict[str, set[str]] = defaultdict(set)
        changed = True
        while changed:
            changed = False
            for p in self.productions:
                before = len(first[p.head]), p.head in nullable
                for step in p.steps:
                    first[p.head] |= {step.symbol} if step.symbol in self.terminals else first[step.symbol]
                    if step.symbol not in nullable:
                        break
                else:
                    nullable.add(p.head)
                changed |= before != (len(first[p.head]), p.head in nullable)
        return nullable, first

    def closure(self, kernel: dict[tuple[int, int], set[str]]) -> dict[tuple[int, int], set[str]]:
        items = {k: set(v) for k, v in kernel.items()}
        work = list(items)
        while work:
            at, dot = item = work.pop()
            steps = self.productions[at].steps
            if dot == len(steps) or steps[dot].symbol in self.terminals:
                continue
            follow: set[str] = set()
            for step in steps[dot + 1 :]:
                follow |= {step.symbol} if step.symbol in self.terminals else self.first[step.symbol]
                if step.symbol not in self.nullable:
                    break
            else:
                follow |= items[item]
            for new in self.by_head[steps[dot].symbol]:
                held = items.setdefault((new, 0), set())
                if (new, 0) not in kernel and not held and not follow or not follow <= held:
                    held |= follow
                    work.append((new, 0))
        return items

    def _state(self, kernel: dict[tuple[int, int], set[str]]) -> tuple[int, bool]:
        key = frozenset(kernel)
        if key not in self.index:
            self.index[key] = len(self.kernels)
            self.kernels.append({k: set(v) for k, v in kernel.items()})
            self.moves.append({})
            return self.index[key], True
        held, grown = self.kernels[self.index[key]], False
        for item, ahead in kernel.items():
            if not ahead <= held[item]:
                held[item] |= ahead
                grown = True
        return self.index[key], grown

    def _run(self) -> None:
        work = [self._state({(self.by_head["~start"][0], 0): {END}})[0]]
        while work:
            state = work.pop()
            after: dict[str, dict[tuple[int, int], set[str]]] = defaultdict(dict)
            for (at, dot), ahead in self.closure(self.kernels[state]).items():
                steps = self.productions[at].steps
                if dot < len(steps):
                    after[steps[dot].symbol][at, dot + 1] = ahead
            for symbol, kernel in after.items():
                to, grown = self._state(kernel)
                self.moves[state][symbol] = to
                if grown and to not in work:
                    work.append(to)


def _settle(options, ahead, automaton: _Automaton, state: int, grammar: GrammarModel, ranks) -> tuple[tuple, ...]:
    """What is left of several actions on one terminal after precedence and associativity."""
    productions = automaton.productions
    reduces = [o for o in options if o[0] == "r"]
    shifts = [o for o in options if o[0] == "s"]

    def rank(a, b) -> int:
        """Is a tighter (1), looser (-1), or neither than b?"""
        a, b = (None if x == 0 else x for x in (a, b))
        if isinstance(a, str) or isinstance(b, str):
            for order in ranks:
                if a in order and b in order:
                    return (order.index(b) > order.index(a)) - (order.index(b) < order.index(a))
            return 0
        return ((a or 0) > (b or 0)) - ((a or 0) < (b or 0))

    if len(reduces) > 1:
        best = [r for r in reduces if not any(rank(productions[o[1]].prec, productions[r[1]].prec) > 0 for o in reduces)]
        if best:
            reduces = best
    if shifts and reduces:
        moving = [
            productions[at]
            for (at, dot) in automaton.closure(automaton.kernels[state])
            if dot < len(productions[at].steps) and productions[at].steps[dot].symbol == ahead and dot > 0
        ]
        # Productions that only begin here take part through the rules that led to them.
        moving = moving or [
            productions[at] for (at, dot) in automaton.closure(automaton.kernels[state]) if dot < len(productions[at].steps) and productions[at].steps[dot].symbol == ahead
        ]
        keep_shift, kept = False, []
        for r in reduces:
            own = productions[r[1]]
            compared = [rank(own.prec, m.prec) for m in moving]
            low, high = min(compared), max(compared)
            if low > 0:
                kept.append(r)
            elif high < 0:
                keep_shift = True
            elif low == high == 0 and own.assoc == "left":
                kept.append(r)
            elif low == high == 0 and own.assoc == "right":
                keep_shift = True
            elif low == 0 and high > 0:
                kept.append(r)
            elif high == 0 and low < 0:
                keep_shift = True
            else:
                kept.append(r)
                keep_shift = True
        reduces, shifts = kept, shifts if keep_shift or not kept else []
    return tuple(shifts + reduces)


def build_tables(grammar: GrammarModel, start: str | None = None) -> Tables:
    """The tables of a grammar, or GrammarConflictError for a conflict that it does not declare."""
    start = start or grammar.start
    builder = _Builder(grammar)
    builder.build(start)
    extras, extra_rules = [], {}
    for expr in grammar.extras:
        name = expr.name if expr.kind == "SYMBOL" else builder.inline_token(expr)
        if name in builder.terminals:
            held = builder.terminals[name]
            builder.terminals[name] = Terminal(**{**held.__dict__, "extra": True})
            extras.append(name)
        elif name in grammar.rules:
            extra_rules[name] = build_tables(GrammarModel(grammar.name, grammar.rules, [e for e in grammar.extras if e.name != name], grammar.conflicts, grammar.precedences, grammar.externals, grammar.inline, grammar.supertypes, grammar.word), name)
            first = _Automaton(extra_rules[name].productions, extra_rules[name].terminals).first[name]
            for token in first:
                builder.terminals.setdefault(token, extra_rules[name].terminals[token])
    terminals = {END: Terminal(END, None, False, None, None), **builder.terminals}
    automaton = _Automaton(builder.productions, terminals)
    ranks = [[e.name if e.kind == "SYMBOL" else e.value for e in order] for order in grammar.precedences]
    declared = [frozenset(c) for c in grammar.conflicts]
    actions, gotos, forking = [], [], False
    for state, kernel in enumerate(automaton.kernels):
        row: dict[str, list[tuple]] = defaultdict(list)
        for symbol, to in automaton.moves[state].items():
            if symbol in terminals:
                row[symbol].append(("s", to))
        for (at, dot), ahead in automaton.closure(kernel).items():
            p = builder.productions[at]
            if dot == len(p.steps):
                for symbol in ahead:
                    row[symbol].append(("a",) if p.head == "~start" else ("r", at))
        done = {}
        for symbol, options in row.items():
            if len(options) > 1:
                options = list(_settle(options, symbol, automaton, state, grammar, ranks))
            if len(options) > 1:
                involved = _involved(automaton, state, symbol, options)
                if not any(involved <= c or _plain(involved) <= c for c in declared):
                    raise GrammarConflictError(_report(automaton, state, symbol, options, involved), grammar)
                forking = True
            done[symbol] = tuple(options)
        actions.append(done)
        gotos.append({s: to for s, to in automaton.moves[state].items() if s not in terminals})
    contexts = [_context(automaton, builder.productions, kernel, grammar.word) for kernel in automaton.kernels] if grammar.reserved and grammar.word else []
    reserved = {k: frozenset(filter(None, map(builder.literal_of, v))) for k, v in grammar.reserved.items()}
    return Tables(
        grammar.name, start, terminals, builder.productions, actions, gotos, tuple(extras), tuple(builder.externals),
        frozenset(builder.hidden), frozenset(grammar.supertypes), grammar.word, reserved, forking, extra_rules, contexts,
    )


def _context(automaton: _Automaton, productions: list[Production], kernel, word: str) -> str | None:
    """The context that the steps next in a state give to its words, themselves or for what they begin with."""
    for at, dot in sorted(automaton.closure(kernel)):
        steps = productions[at].steps
        if dot < len(steps) and steps[dot].reserved is not None and (steps[dot].symbol == word or word in automaton.first.get(steps[dot].symbol, ())):
            return steps[dot].reserved
    return None


def _plain(names: frozenset[str]) -> frozenset[str]:
    return frozenset(n.split("~")[0] for n in names)


def _involved(automaton: _Automaton, state: int, symbol: str, options) -> frozenset[str]:
    heads = {automaton.productions[o[1]].head for o in options if o[0] == "r"}
    if any(o[0] == "s" for o in options):
        for (at, dot) in automaton.kernels[state]:
            steps = automaton.productions[at].steps
            if dot < len(steps):
                nxt = steps[dot].symbol
                if nxt == symbol or symbol in automaton.first.get(nxt, ()):
                    heads.add(automaton.productions[at].head)
    return _plain(frozenset(heads))


def _report(automaton: _Automaton, state: int, symbol: str, options, involved) -> Conflict:
    """The conflict in words: what was read, and the ways to go on."""
    kernel = automaton.kernels[state]
    sample = max(kernel, key=lambda item: item[1])
    read = [s.symbol for s in automaton.productions[sample[0]].steps[: sample[1]]]
    ways = []
    for option in options:
        if option[0] == "r":
            p = automaton.productions[option[1]]
            ways.append({"variable_name": p.head.split("~")[0], "production_step_symbols": [s.symbol for s in p.steps], "step_index": len(p.steps), "done": True, "precedence": p.prec, "associativity": p.assoc})
        else:
            for (at, dot) in kernel:
                p = automaton.productions[at]
                if dot < len(p.steps) and (p.steps[dot].symbol == symbol or symbol in automaton.first.get(p.steps[dot].symbol, ())):
                    ways.append({"variable_name": p.head.split("~")[0], "production_step_symbols": [s.symbol for s in p.steps], "step_index": dot, "done": False, "precedence": p.prec, "associativity": p.assoc})
    fixes = [{"type": "Precedence", "symbols": sorted(involved)}, {"type": "AddConflict", "symbols": sorted(involved)}]
    if len(involved) == 1:
        fixes.insert(1, {"type": "Associativity", "symbols": sorted(involved)})
    return Conflict(tuple(read), symbol, tuple(ways), tuple(fixes))
