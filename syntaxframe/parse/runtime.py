"""The table-driven parser that runs in workers.

It lexes by context (only tokens that the current state can use, plus extras), shifts and reduces with an explicit linked
stack, and forks where the tables hold several actions (Tomita, 1985; forks with equal stacks are merged, the better
dynamic precedence stays). Any text gives a tree: where no action fits, a missing token is put in if that lets parsing go on,
else the least stretch is wrapped in an ERROR node; a text with more than MAX_FORKS ways open at once is one ERROR node, never
the tree of some of them. Positions are code points here; rows.py turns them into bytes.

A text is parsed by remembered moves as far as they go: what a whole stack of states does on a token is worked out once and
kept (at most MOST_STACKS stacks), so a token costs one lookup. Forks, errors, scanners and extras that are nodes are left to
the step-by-step parser, which takes over in the middle of a text.
"""

from __future__ import annotations

import re
from itertools import count

from ..grammar.tables import END, Tables

try:
    import regex as wide_regex
except ImportError:  # patterns with \p{..} then cannot be used
    wide_regex = None

#: Forks with different stacks that are alive at once. A text that needs more is too ambiguous: its tree is one ERROR node.
MAX_FORKS = 1024
#: Stacks whose moves are remembered, and states in one. Others are parsed step by step.
MOST_STACKS, DEEPEST_STACK = 20_000, 150
#: Characters whose candidate tokens are remembered, for each state.
MOST_CHARS = 1024


class Node:
    """A node of the tree. ``children`` holds (field, node) pairs."""

    __slots__ = ("kind", "named", "start", "end", "children", "extra", "error", "missing")

    def __init__(self, kind, named, start, end, children=(), extra=False, error=False, missing=False):
        self.kind, self.named, self.start, self.end = kind, named, start, end
        self.children, self.extra, self.error, self.missing = children, extra, error, missing

    def child(self, field: str) -> Node | None:
        return next((n for f, n in self.children if f == field), None)

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(n for _, n in reversed(node.children))

    def first_error(self) -> Node | None:
        return next((n for n in self.walk() if n.error or n.missing), None)

    def text(self, source: str) -> str:
        return source[self.start : self.end]

    def __repr__(self):
        return f"<{self.kind} {self.start}-{self.end}>"


class Tree(Node):
    """A root that knows its text, and places between top-level nodes at which parsing can be taken up again: (position of the next
    token, its end, states, number of nodes before). ``parsed``: characters that were gone over to make it."""

    __slots__ = ("source", "marks", "parsed")


def kept_tree(root: Node, text: str, marks: list[tuple], parsed: int = 0) -> Tree:
    tree = Tree(root.kind, root.named, root.start, root.end, root.children, root.extra, root.error, root.missing)
    tree.source, tree.marks, tree.parsed = text, marks, parsed
    return tree


def same_trees(a: Node, b: Node) -> bool:
    """Have two trees the same nodes at the same places?"""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if a.start != b.start or a.end != b.end or a.kind != b.kind or a.named != b.named or a.missing != b.missing or a.error != b.error or a.extra != b.extra:
            return False
        if len(a.children) != len(b.children):
            return False
        for (f, c), (g, d) in zip(a.children, b.children):
            if f != g:
                return False
            stack.append((c, d))
    return True


def _moved(node: Node, by: int) -> None:
    for n in node.walk():
        n.start += by
        n.end += by


def compiled(pattern: str):
    return (wide_regex if wide_regex and r"\p" in pattern else re).compile(pattern)


#: In a pattern, these look at what stands before a token, so that a character alone does not tell whether it can begin one.
_LOOKS_BACK = re.compile(r"\(\?<[=!]|\\[bBAG]|\^")


class _Lexer:
    """Tokens for each state, with the candidates for each first character."""

    def __init__(self, tables: Tables, valid: frozenset[str], word, reserved_text: frozenset[str] = frozenset()):
        self.patterns, self.literals, self.externals = [], {}, frozenset(valid & set(tables.externals))
        self.reserved_text = reserved_text
        names = set(tables.terminals)
        order = {name: i for i, name in enumerate(tables.terminals)}
        for name in sorted(valid & names, key=order.get):
            t = tables.terminals[name]
            if t.external or t.regex is None:
                continue
            if t.literal is not None:
                keyword = word is not None and word.fullmatch(t.literal) is not None
                self.literals.setdefault(t.literal[:1], []).append((t.literal, name, t, keyword))
            else:
                self.patterns.append((compiled(t.regex).match, name, t))
        self.end = END in valid
        self.by_char: dict[str, tuple[list, list]] = {}

    def candidates(self, ch: str) -> tuple[list, list]:
        """Literals and patterns that may begin with a character."""
        found = self.by_char.get(ch)
        if found is None:
            found = self.literals.get(ch, []), [p for p in self.patterns if _may_begin(p[2].regex, ch)]
            if len(self.by_char) < MOST_CHARS:
                self.by_char[ch] = found
        return found


#: The two regular expression engines see different members in these, beyond ASCII.
_CLASSES = re.compile(r"\\[wWdDsS]")


def _may_begin(pattern: str, ch: str) -> bool:
    if wide_regex is None or _LOOKS_BACK.search(pattern) or (not " " <= ch <= "~" and _CLASSES.search(pattern)):
        return True
    return wide_regex.match(pattern, ch, partial=True) is not None


class _Stack:
    """A stack of states and what it does on each token: (productions to reduce, node of the token, next stack) or None."""

    __slots__ = ("states", "lexer", "moves", "valid")

    def __init__(self, states, lexer, valid):
        self.states, self.lexer, self.valid, self.moves = states, lexer, valid, {}


def _common(a: str, b: str, most: int) -> int:
    """Length of the common head, by halving."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class _Made:
    """A production, ready for reducing."""

    __slots__ = ("size", "head", "shown", "steps", "plain")

    def __init__(self, production, hidden):
        self.size, self.head, self.shown, self.steps = len(production.steps), production.head, production.head not in hidden, production.steps
        self.plain = all(s.alias is None and s.field is None for s in production.steps)


class _Entry:
    """A stack entry. ``pairs`` are the (field, node) pairs it brings to its parent."""

    __slots__ = ("below", "state", "pairs", "start", "end", "extra", "number")

    def __init__(self, below, state, pairs, start, end, extra=False):
        self.below, self.state, self.pairs, self.start, self.end, self.extra = below, state, pairs, start, end, extra
        self.number = next(_numbers)


#: Entries are numbered as they are made, so that a fork can tell its own from those before it.
_numbers = count()


class _Head:
    """One fork: its stack, position, scanner state and dynamic precedence."""

    __slots__ = ("top", "pos", "memory", "score", "token")

    def __init__(self, top, pos, memory, score=0, token=None):
        self.top, self.pos, self.memory, self.score, self.token = top, pos, memory, score, token


class Parser:
    def __init__(self, tables: Tables, scanner=None):
        self.t, self.scanner = tables, scanner
        word = tables.terminals.get(tables.word) if tables.word else None
        self.word = compiled(word.regex) if word and word.regex else None
        self.word_name = tables.word
        self.first_reserved = next(iter(tables.reserved.values()), frozenset())
        self.extras = frozenset(tables.extras)
        extra_starts = {}
        for name, sub in tables.extra_rules.items():
            for token in sub.actions[0]:
                extra_starts.setdefault(token, name)
        self.extra_starts = extra_starts
        self.sub = {name: Parser(sub, scanner) for name, sub in tables.extra_rules.items()}
        self.lexers: dict[int, _Lexer] = {}
        self.looks_ahead = any(t.regex and re.search(r"\(\?[=!]|\$|\\[bBzZ]", t.regex) for t in tables.terminals.values())
        self.every = frozenset(tables.terminals) - {END} - set(tables.externals)
        self.made = [_Made(p, tables.hidden) for p in tables.productions]
        self.stacks: dict[tuple[int, ...], _Stack] = {}
        self.shapes = None  # shapes.py keeps its own here

    # Lexing.

    def _lexer(self, state: int) -> _Lexer:
        lexer = self.lexers.get(state)
        if lexer is None:
            valid = self.every if state < 0 else frozenset(self.t.actions[state])
            context = self.t.contexts[state] if state >= 0 and self.t.contexts else None
            reserved = self.first_reserved if context is None else self.t.reserved.get(context, frozenset())
            lexer = self.lexers[state] = _Lexer(self.t, valid | self.extras | set(self.extra_starts), self.word, reserved)
        return lexer

    def _match(self, lexer: _Lexer, text: str, pos: int, fresh: bool):
        """(precedence, end, name) of the best token at pos. fresh: nothing was skipped since the last token."""
        best = None
        literals, patterns = lexer.candidates(text[pos : pos + 1])
        if len(patterns) == 1 and not literals:
            match, name, t = patterns[0]
            found = match(text, pos) if fresh or not t.immediate else None
            if found is None or found.end() == pos or (name == self.word_name and found.group() in lexer.reserved_text):
                return None
            return None, found.end(), name
        for literal, name, t, keyword in literals:
            if (fresh or not t.immediate) and text.startswith(literal, pos):
                end = pos + len(literal)
                if keyword and self.word.match(text, pos).end() != end:
                    continue
                key = (t.prec, end, 1)
                if best is None or key > best[0]:
                    best = key, end, name
        for match, name, t in patterns:
            if fresh or not t.immediate:
                found = match(text, pos)
                if found and found.end() > pos:
                    end = found.end()
                    key = (t.prec, end, 0)
                    if best is None or key > best[0]:
                        if name == self.word_name and text[pos:end] in lexer.reserved_text:
                            continue
                        best = key, end, name
        return best

    def _lex(self, head: _Head, text: str, state: int | None = None):
        """The next token (name, start, end, scanner state), or None where nothing fits. Extras are put on the stack."""
        lexer = self._lexer(head.top.state if state is None else state)
        fresh_at = head.pos
        while True:
            pos = head.pos
            if lexer.externals and self.scanner is not None:
                found = self.scanner.scan(head.memory, lexer.externals, text, pos)
                if found:
                    name, start, end, memory = found
                    return name, start, end, memory
            best = self._match(lexer, text, pos, pos == fresh_at) if pos < len(text) else None
            if best is None:
                if pos >= len(text):
                    return (END, pos, pos, head.memory)
                return None
            _, end, name = best
            if name in self.extra_starts and name not in self.t.actions[head.top.state]:
                rule = self.extra_starts[name]
                node, end = self.sub[rule].prefix(text, pos, head.memory)
                node.extra = True
                head.top = _Entry(head.top, head.top.state, ((None, node),), pos, end, True)
                head.pos = end
                continue
            if name in self.extras and name not in self.t.actions[head.top.state]:
                t = self.t.terminals[name]
                if t.kind is not None:
                    node = Node(t.kind, t.named, pos, end, extra=True)
                    head.top = _Entry(head.top, head.top.state, ((None, node),), pos, end, True)
                head.pos = end
                continue
            return name, pos, end, head.memory

    # Stack moves.

    def _shift(self, head: _Head, to: int, token, missing: bool = False) -> None:
        name, start, end, memory = token
        t = self.t.terminals[name]
        pairs = () if t.kind is None else ((None, Node(t.kind, t.named, start, end, missing=missing)),)
        head.top = _Entry(head.top, to, pairs, start, end)
        head.pos, head.memory, head.token = end, memory, None

    def _reduce(self, head: _Head, number: int) -> None:
        p = self.t.productions[number]
        entry, trailing, taken = head.top, [], []
        need = len(p.steps)
        while entry.extra:
            trailing.append(entry)
            entry = entry.below
        if need:
            while need:
                taken.append(entry)
                need -= not entry.extra
                entry = entry.below
        taken.reverse()
        step, pairs, start, end = 0, [], None, None
        for e in taken:
            if e.extra:
                pairs.extend(e.pairs)
                continue
            pairs.extend(self._marked(e.pairs, e.start, e.end, p.steps[step]))
            step += 1
            if start is None:
                start = e.start
            end = e.end
        if start is None:
            start = end = head.pos if not trailing else trailing[-1].start
        if p.head not in self.t.hidden:
            pairs = ((None, Node(p.head, True, start, end, pairs)),)
        head.top = _Entry(entry, self.t.gotos[entry.state][p.head], pairs, start, end)
        for e in reversed(trailing):
            head.top = _Entry(head.top, head.top.state, e.pairs, e.start, e.end, True)
        head.score += p.dynamic

    # Parsing.

    def parse(self, text: str, keep: bool = False) -> Node:
        """The tree of a whole text. keep: a Tree, for reparse()."""
        marks: list[tuple] | None = [] if keep else None
        head = self._quick(text, marks) if self.scanner is None and not self.extra_starts else None
        if head is None:
            memory = self.scanner.start() if self.scanner is not None else None
            head = _Head(_Entry(None, 0, (), 0, 0), 0, memory)
        whole = head.token == "accepted"
        if not whole:
            head = self._run(head, text)
        root = self._root(head, text)
        return kept_tree(root, text, marks if whole else [], len(text)) if keep else root

    def reparse(self, old: Node, text: str) -> Node:
        """The tree of a text that was changed in one stretch, with what the old tree (a Tree, used up by this) has before and behind it."""
        marks = getattr(old, "marks", None)
        if not marks or old.error:
            return self.parse(text, keep=True)
        if old.source == text:
            old.parsed = 0
            return old
        size, (first, tail, grown) = len(text), self.change(old, text)
        # Without a place before the change, the text is parsed from its beginning.
        pos, _, states, n = (0, 0, None, 0) if first is None else marks[first]
        behind = {at + grown: (states, i) for i, (at, _, states, _) in enumerate(marks) if at >= tail} if not self.looks_ahead else {}
        new, since = ([], None) if first is None else (marks[:first], (self._stack(states), pos, old.children[:n]))
        done = self._quick(text, new, since, behind)
        if done is None or done.token not in ("accepted", "joined"):
            return self.parse(text, keep=True)
        if done.token == "joined":
            at, pairs = done.pos, done.memory
            _, i = behind[at]
            rest = old.children[marks[i][3] :]
            added = len(pairs) - marks[i][3]
            for _, node in rest:
                _moved(node, grown)
            new += [(a + grown, b + grown, s, k + added) for a, b, s, k in marks[i:]]
            root = Node(old.kind, old.named, 0, size, [*pairs, *rest])
        else:
            root = self._root(done, text)
        return kept_tree(root, text, new, (done.pos if done.token == "joined" else size) - pos)

    def change(self, old: Tree, text: str) -> tuple[int | None, int, int]:
        """What is different in a text: the last of the old tree's marks before it (None: there is none), the place in the old text from which on
        both are the same, and how far that has moved."""
        before = old.source
        least = min(len(before), len(text))
        head = _common(before, text, least)
        tail = len(before) - _common(before[::-1], text[::-1], least - head)
        # A token may look at one character behind it, and patterns at more only where they say so; a whole token is left between.
        first = None if self.looks_ahead else next((i for i in reversed(range(len(old.marks))) if old.marks[i][1] < head), None)
        return first, tail, len(text) - len(before)

    def _stack(self, states: tuple[int, ...]) -> _Stack | None:
        found = self.stacks.get(states)
        if found is None:
            lexer = self._lexer(states[-1])
            if len(states) > DEEPEST_STACK or len(self.stacks) >= MOST_STACKS or lexer.externals:
                return None
            found = self.stacks[states] = _Stack(states, lexer, self.t.actions[states[-1]])
        return found

    def _move(self, stack: _Stack, name: str):
        """What a stack does on a token, or None where this is for the step-by-step parser."""
        states, reduced, out = list(stack.states), [], None
        while True:
            acts = self.t.actions[states[-1]].get(name)
            if not acts or len(acts) > 1:
                break
            act = acts[0]
            if act[0] == "r":
                p = self.made[act[1]]
                del states[len(states) - p.size :]
                states.append(self.t.gotos[states[-1]][p.head])
                reduced.append(p)
                continue
            if act[0] == "a":
                out = tuple(reduced), None, self._stack(tuple(states)), None
            else:
                t = self.t.terminals[name]
                # Between two top-level nodes only the list of those before is on the stack.
                between = tuple(states) if len(states) == 2 and self._stack(tuple(states)) else None
                out = tuple(reduced), t if t.kind is not None else False, self._stack((*states, act[1])), between
            break
        if out is not None and out[2] is None:
            out = None
        stack.moves[name] = out
        return out

    def _quick(self, text: str, marks: list[tuple] | None = None, since: tuple | None = None, behind: dict | None = None) -> _Head | None:
        """Parses by remembered moves; the head at the end of the text, or at the token from which steps have to be taken.

        marks: takes the places between top-level nodes. since: (stack, position, nodes before) to begin with. behind: places of
        an old tree; at the first at which the stack is as it was, parsing ends as "joined", with the nodes so far as memory.
        """
        values: list[tuple] = []  # (pairs, start, end) of each state but the first
        if since is None:
            stack, pos = self._stack((0,)), 0
        else:
            stack, pos, pairs = since
            values.append((pairs, pairs[0][1].start if pairs else pos, pos))
        if stack is None:
            return None
        extras, terminals, match, size = self.extras, self.t.terminals, self._match, len(text)
        while True:
            lexer, at = stack.lexer, pos
            while True:
                if at >= size:
                    name, end = END, at
                    break
                best = match(lexer, text, at, at == pos)
                if best is None:
                    return self._handed_over(stack, values, pos)
                _, end, name = best
                if name in extras and name not in stack.valid:
                    if terminals[name].kind is not None:
                        return self._handed_over(stack, values, pos)
                    at = end
                    continue
                break
            moves = stack.moves
            move = moves[name] if name in moves else self._move(stack, name)
            if move is None:
                return self._handed_over(stack, values, pos)
            reduced, token, to, between = move
            for p in reduced:
                n = p.size
                if n == 1:
                    pairs, start, stop = values.pop()
                    if not p.plain:
                        pairs = self._marked(pairs, start, stop, p.steps[0])
                elif n:
                    parts = values[-n:]
                    del values[-n:]
                    start, stop = parts[0][1], parts[-1][2]
                    if p.plain:
                        # A list on the stack is nobody else's.
                        pairs = parts[0][0]
                        pairs = pairs if type(pairs) is list else [*pairs]
                        for part in parts[1:]:
                            pairs.extend(part[0])
                    else:
                        pairs = []
                        for (own, a, b), step in zip(parts, p.steps):
                            pairs.extend(self._marked(own, a, b, step))
                else:
                    pairs, start, stop = [], at, at
                if p.shown:
                    pairs = ((None, Node(p.head, True, start, stop, pairs)),)
                values.append((pairs, start, stop))
            if marks is not None and len(values) == 1 and between is not None and type(values[0][0]) is list:
                if behind is not None and at in behind and behind[at][0] == between:
                    head = _Head(None, at, values[0][0], 0, "joined")
                    return head
                marks.append((at, end, between, len(values[0][0])))
            if token is None:
                head = self._handed_over(to, values, at)
                head.token = "accepted"
                return head
            values.append((((None, Node(token.kind, token.named, at, end)),) if token else (), at, end))
            stack, pos = to, end

    def _handed_over(self, stack: _Stack, values: list[tuple], pos: int) -> _Head:
        entry = _Entry(None, stack.states[0], (), 0, 0)
        for state, (pairs, start, end) in zip(stack.states[1:], values):
            entry = _Entry(entry, state, pairs, start, end)
        return _Head(entry, pos, None)

    def _marked(self, pairs, start: int, end: int, step):
        """The pairs that a symbol brings to its parent, under the step's alias and field."""
        if step.alias is not None:
            if len(pairs) == 1 and step.symbol not in self.t.hidden:
                n = pairs[0][1]
                pairs = ((pairs[0][0], Node(step.alias, step.alias_named, n.start, n.end, n.children, n.extra, n.error, n.missing)),)
            elif pairs or end > start:
                pairs = ((None, Node(step.alias, step.alias_named, start, end, list(pairs))),)
        if step.field is not None:
            pairs = [(f or step.field, n) if not n.extra else (f, n) for f, n in pairs]
        return pairs

    def prefix(self, text: str, pos: int, memory) -> tuple[Node, int]:
        """The tree of the longest run from pos that the start rule takes up (for extras that are rules)."""
        head = _Head(_Entry(None, 0, (), pos, pos), pos, memory)
        while True:
            token = self._lex(head, text)
            acts = self.t.actions[head.top.state].get(token[0]) if token else None
            if not acts:
                token = (END, head.pos, head.pos, head.memory)
                acts = self.t.actions[head.top.state].get(END)
                if not acts:
                    return Node("ERROR", True, pos, max(pos + 1, head.pos), error=True), max(pos + 1, head.pos)
            act = acts[0]
            if act[0] == "a":
                return head.top.pairs[0][1], head.pos
            if act[0] == "s":
                self._shift(head, act[1], token)
            else:
                self._reduce(head, act[1])

    def _run(self, head: _Head, text: str) -> _Head:
        actions = self.t.actions
        while True:
            token = head.token or self._lex(head, text)
            acts = actions[head.top.state].get(token[0]) if token else None
            if acts is None:
                if self._recover(head, text, token):
                    return head
                continue
            if len(acts) > 1:
                head.token = token
                head = self._fork(head, text)
                if head.token in ("accepted", "given up"):
                    return head
                continue
            act = acts[0]
            if act[0] == "s":
                self._shift(head, act[1], token)
            elif act[0] == "r":
                head.token = token
                self._reduce(head, act[1])
            else:
                return head

    def _fork(self, head: _Head, text: str) -> _Head:
        """Runs all ways on until one is left, or some accept."""
        heads, accepted, last, before = [head], [], head, head.top.number
        while heads:
            at = min(h.pos for h in heads)
            moved, behind = [], [h for h in heads if h.pos != at]
            for h in (h for h in heads if h.pos == at):
                last = h
                work = [h]
                while work:
                    now = work.pop()
                    token = now.token or self._lex(now, text)
                    acts = self.t.actions[now.top.state].get(token[0]) if token else None
                    for act in reversed(acts or ()):
                        new = _Head(now.top, now.pos, now.memory, now.score, token)
                        if act[0] == "s":
                            self._shift(new, act[1], token)
                            moved.append(new)
                        elif act[0] == "r":
                            self._reduce(new, act[1])
                            work.append(new)
                        else:
                            new.token = "accepted"
                            accepted.append(new)
            kept: dict[tuple, _Head] = {}
            for h in behind + moved:
                key = h.pos, self._states(h.top, before)
                if key not in kept or h.score > kept[key].score:
                    kept[key] = h
            heads = sorted(kept.values(), key=lambda h: -h.score)
            if len(heads) > MAX_FORKS:
                head.top, head.pos, head.token = _Entry(None, 0, (), 0, 0), len(text), "given up"
                return head
            if accepted and not heads:
                return max(accepted, key=lambda h: h.score)
            if len(heads) == 1 and not accepted:
                return heads[0]
        last.token = None
        return last

    @staticmethod
    def _states(entry: _Entry | None, before: int) -> tuple[int, ...]:
        """States that entries made since a fork began bring, down to the entry from before it on which they stand."""
        out = []
        while entry is not None and entry.number > before:
            if not entry.extra:
                out.append(entry.state)
            entry = entry.below
        out.append(-1 if entry is None else entry.number)
        return tuple(out)

    # Recovery.

    def _after(self, top: _Entry | None, name: str, above: tuple[int, ...] = ()) -> tuple[_Entry | None, tuple[int, ...]] | None:
        """The stack (an entry, and states above it) after the reductions that name leads to and its shift, if it can be shifted
        or accepted. ``above``: states on top of the entry to begin with."""
        states, gone = list(above), 0
        while True:
            while top is not None and top.extra:
                top = top.below
            state = states[-1] if states else top.state
            acts = self.t.actions[state].get(name)
            if not acts:
                return None
            act = acts[0]
            if act[0] == "a":
                return top, tuple(states)
            if act[0] == "s":
                return top, (*states, act[1])
            p = self.t.productions[act[1]]
            # More reductions in a row that take nothing away than there are states would go on for ever.
            gone = 0 if len(p.steps) > 1 else gone + 1
            if gone > 2 * len(self.t.actions):
                return None
            need = len(p.steps)
            kept = max(0, len(states) - need)
            need -= len(states) - kept
            del states[kept:]
            while need:
                need -= not top.extra
                top = top.below
            while top is not None and top.extra:
                top = top.below
            under = states[-1] if states else top.state
            states.append(self.t.gotos[under][p.head])

    def _recover(self, head: _Head, text: str, token) -> bool:
        """Gets the head going again; True if the text is used up."""
        head.token = None
        any_token = token if token and token[0] != END else None
        if any_token is None and head.pos < len(text):
            found = self._match(self._lexer(-1), text, head.pos, False)
            any_token = (found[2], head.pos, found[1], head.memory) if found else None
        ahead = any_token[0] if any_token else END if head.pos >= len(text) else None
        # One missing token that makes the next one fit.
        if ahead is not None:
            for name in sorted(self.t.actions[head.top.state], key=lambda n: self.t.terminals[n].literal is None):
                t = self.t.terminals[name]
                # Punctuation and scanner tokens can be put in; names and values cannot be guessed.
                if name == END or name in self.extras or (t.external and ahead != END) or (t.literal is None and not t.external):
                    continue
                found = self._after(head.top, name)
                if found and self._after(*found[:1], ahead, found[1]):
                    while (act := self.t.actions[head.top.state][name][0])[0] == "r":
                        self._reduce(head, act[1])
                    self._shift(head, act[1], (name, head.pos, head.pos, head.memory), missing=True)
                    return False
        # The nearest state below that can go on.
        if ahead is not None:
            entry, popped = head.top, []
            while entry is not None:
                if (entry.extra is False or not popped) and self._after(entry, ahead) and (popped or entry is not head.top):
                    self._wrap(head, entry, popped, head.pos)
                    return False
                popped.append(entry)
                entry = entry.below
        if head.pos >= len(text):
            # Nothing accepts the end: give up with what there is.
            head.token = "given up"
            return True
        end = any_token[2] if any_token else head.pos + 1
        start = head.pos
        if head.top.extra and head.top.pairs and head.top.pairs[0][1].error and head.top.end == start:
            head.top.pairs[0][1].end = head.top.end = end
        else:
            head.top = _Entry(head.top, head.top.state, ((None, Node("ERROR", True, start, end, [], True, True)),), start, end, True)
        head.pos = end
        return False

    def _wrap(self, head: _Head, entry: _Entry, popped: list[_Entry], end: int) -> None:
        pairs = [pair for e in reversed(popped) for pair in e.pairs]
        start = min((e.start for e in popped), default=end)
        error = Node("ERROR", True, start, max([start, *(e.end for e in popped)]), pairs, True, True)
        head.top = _Entry(entry, entry.state, ((None, error),), start, error.end, True)

    def _root(self, head: _Head, text: str) -> Node:
        """The start node with all that stands around it, or an ERROR node over everything."""
        entries, entry = [], head.top
        while entry is not None:
            entries.append(entry)
            entry = entry.below
        entries.reverse()
        pairs = [pair for e in entries for pair in e.pairs]
        solid = [n for _, n in pairs if not n.extra]
        if head.token != "given up" and len(solid) == 1 and solid[0].kind == self.t.start:
            root = solid[0]
            at = next(i for i, (_, n) in enumerate(pairs) if n is root)
            root.children = [*pairs[:at], *root.children, *pairs[at + 1 :]]
        elif head.token != "given up" and not solid and self.t.start in self.t.hidden:
            root = Node(self.t.start, True, 0, len(text), pairs)
        else:
            root = Node("ERROR", True, 0, len(text), pairs, error=True)
        root.start, root.end, root.extra = 0, len(text), False
        return root
