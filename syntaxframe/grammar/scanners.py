"""External scanners in Python.

``start()`` gives the first state; ``scan(state, valid, text, pos)`` gives (token, start, end, new state), or None. States are
immutable, so forks can go on from the same one. Scanners are asked before blanks are skipped.
"""

from __future__ import annotations

import re

from ..errors import CompileError


class IndentScanner:
    """NEWLINE, INDENT and DEDENT from the indentation of lines. Comment lines count as lines; tabs count as ``tab``."""

    names = ("NEWLINE", "INDENT", "DEDENT")

    def __init__(self, tab: int = 1, names: tuple[str, str, str] = names, blank_lines: bool = True):
        self.tab, self.names, self.blank_lines = tab, names, blank_lines

    def start(self):
        return ((0,), 0, False)  # levels, dedents still owed, newline given at the end

    def scan(self, state, valid, text, pos):
        levels, owed, done = state
        newline, indent, dedent = self.names
        if owed and dedent in valid:
            return dedent, pos, pos, (levels, owed - 1, done)
        at = pos
        while at < len(text) and text[at] in " \t\r":
            at += 1
        if at >= len(text):
            if newline in valid and not done:
                return newline, pos, pos, (levels, 0, True)
            if dedent in valid and len(levels) > 1:
                return dedent, pos, pos, (levels[:-1], 0, done)
            return None
        if text[at] == "\n" and newline in valid:
            end, width = self._next_line(text, at)
            return newline, at, end, (levels, 0, False)
        if pos == 0 or text[pos - 1] == "\n" or self._line_start(text, pos):
            width = self._width(text, pos)
            if indent in valid and width > levels[-1]:
                return indent, at, at, ((*levels, width), 0, False)
            if dedent in valid and width < levels[-1]:
                left = levels
                while len(left) > 1 and left[-1] > width:
                    left = left[:-1]
                return dedent, pos, pos, (left, len(levels) - len(left) - 1, False)
        return None

    def _line_start(self, text: str, pos: int) -> bool:
        return not text[text.rfind("\n", 0, pos) + 1 : pos].strip(" \t\r")

    def _width(self, text: str, pos: int) -> int:
        width = 0
        for ch in text[text.rfind("\n", 0, pos) + 1 :]:
            if ch == " ":
                width += 1
            elif ch == "\t":
                width += self.tab - width % self.tab if self.tab > 1 else 1
            else:
                break
        return width

    def _skippable(self, line: str) -> bool:
        return not line.strip()

    def _next_line(self, text: str, at: int) -> tuple[int, int]:
        """Past this line's end and the lines that count for nothing."""
        end = at + 1
        while end < len(text):
            stop = text.find("\n", end)
            stop = len(text) if stop < 0 else stop
            if not self._skippable(text[end:stop]) or stop == len(text):
                break
            end = stop + 1
        return end, 0


class PyIndentScanner(IndentScanner):
    """Logical lines: blank and comment lines give nothing, a backslash joins lines, a tab goes to the next multiple of 8."""

    def __init__(self):
        super().__init__(tab=8)

    def scan(self, state, valid, text, pos):
        at = pos
        while True:
            while at < len(text) and text[at] in " \t\r":
                at += 1
            if text.startswith("\\\n", at):
                at += 2
                pos = at
                continue
            break
        if at < len(text) and text[at] == "#" and self.names[0] in valid:
            stop = text.find("\n", at)
            if stop < 0:
                return None
            if self._line_start(text, at):
                return super().scan(state, valid, text, stop)
        return super().scan(state, valid, text, pos)

    def _skippable(self, line: str) -> bool:
        return not line.strip() or line.strip().startswith("#")


class HeredocScanner:
    """One heredoc at a time: START is the delimiter, BODY all up to and with the line that repeats it (or the end)."""

    names = ("HEREDOC_START", "HEREDOC_BODY")

    def start(self):
        return None

    def scan(self, state, valid, text, pos):
        start, body = self.names
        if start in valid and state is None:
            m = re.compile(r"[ \t]*([A-Za-z_][A-Za-z0-9_]*)").match(text, pos)
            return (start, m.start(1), m.end(1), m.group(1)) if m else None
        if body in valid and state is not None:
            at = text.find("\n", pos)
            if at < 0:
                return (body, pos, len(text), None) if pos < len(text) else None
            begin = at + 1
            m = re.compile(rf"^{re.escape(state)}[ \t]*$", re.M).search(text, begin)
            end = m.end() if m else len(text)
            return body, begin, end, None
        return None


class MatchedScanner:
    """One token from an opening bracket to the one that closes it; none if it never does."""

    def __init__(self, token: str = "MATCHED", opening: str = "(", closing: str = ")"):
        self.names, self.opening, self.closing = (token,), opening, closing

    def start(self):
        return None

    def scan(self, state, valid, text, pos):
        if self.names[0] not in valid:
            return None
        while pos < len(text) and text[pos] in " \t\r\n":
            pos += 1
        if pos >= len(text) or text[pos] != self.opening:
            return None
        depth = 0
        for at in range(pos, len(text)):
            depth += (text[at] == self.opening) - (text[at] == self.closing)
            if depth == 0:
                return self.names[0], pos, at + 1, state
        return None


class BashHeredocScanner:
    """Any number of heredocs on a line, in order; ``<<-`` strips tabs, quoted delimiters are bare ones."""

    names = ("heredoc_start", "heredoc_body")

    def start(self):
        return ()  # (delimiter, strip tabs) of the heredocs begun, and where the last body ended

    def scan(self, state, valid, text, pos):
        start, body = self.names
        if start in valid:
            m = re.compile(r"[ \t]*(-?)[ \t]*(?:'([^'\n]+)'|\"([^\"\n]+)\"|\\?([A-Za-z_][A-Za-z0-9_]*))").match(text, pos)
            if m is None:
                return None
            word = m.group(2) or m.group(3) or m.group(4)
            return start, m.start(0) + len(m.group(0)) - len(m.group(0).lstrip()), m.end(), (*state, (word, bool(m.group(1))))
        if body in valid and state:
            (word, strip), rest = state[0], state[1:]
            at = text.find("\n", pos)
            if at < 0:
                return None
            m = re.compile(rf"^{'[\t]*' if strip else ''}{re.escape(word)}$", re.M).search(text, at + 1)
            end = m.end() if m else len(text)
            return body, at + 1, end, rest
        return None


class QueuedHeredocScanner:
    """Heredocs begun on one line, whose bodies follow it in the same order. START is ``<<``, an optional ``-`` and the delimiter, BODY
    all from where it is asked for up to and with the line that is the delimiter (after tabs, with ``-``), or the end."""

    names = ("QUEUED_START", "QUEUED_BODY")

    def start(self):
        return ()

    def scan(self, state, valid, text, pos):
        start, body = self.names
        if start in valid:
            m = re.compile(r"[ \t]*(<<(-?)(['\"]?)([^\s'\"]+)['\"]?)").match(text, pos)
            if m:
                return start, m.start(1), m.end(), (*state, (m.group(4), bool(m.group(2))))
        if body in valid and state and pos < len(text):
            (word, strip), rest = state[0], state[1:]
            m = re.compile(rf"^{'[\t]*' if strip else ''}{re.escape(word)}$", re.M).search(text, pos)
            return body, pos, m.end() if m else len(text), rest
        return None


class FragmentScanner:
    """The text of a quoted string up to its end quote or a ``${`` interpolation."""

    names = ("string_fragment",)

    def start(self):
        return None

    def scan(self, state, valid, text, pos):
        if self.names[0] not in valid:
            return None
        m = re.compile(r'(?:[^"\\$]|\\.|\$(?!\{))+', re.S).match(text, pos)
        return (self.names[0], pos, m.end(), state) if m else None


SCANNERS = {
    "indent": IndentScanner, "heredoc": HeredocScanner, "matched_delimiter": MatchedScanner,
    "py_indent": PyIndentScanner, "bash_heredoc": BashHeredocScanner, "queued_heredoc": QueuedHeredocScanner, "fragment": FragmentScanner,
}


def scanner_for(name: str):
    """A scanner of the library by name."""
    if name not in SCANNERS:
        raise CompileError(f"no scanner {name!r}; there are {sorted(SCANNERS)}")
    return SCANNERS[name]()
