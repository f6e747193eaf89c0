"""Reports of grammar conflicts: what was read, what comes next, the ways to go on, and what would settle it."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from ..errors import GenerateError
from .ir import GrammarModel, Site

#: The report type that is a conflict, in JSON reports of table builders.
CONFLICT_KEY = ("BuildTables", "Conflict")


@dataclass(frozen=True)
class Conflict:
    symbol_sequence: tuple[str, ...]
    conflicting_lookahead: str
    possible_interpretations: tuple[dict[str, Any], ...] = ()
    possible_resolutions: tuple[dict[str, Any], ...] = ()

    @property
    def involved_rules(self) -> list[str]:
        return list(dict.fromkeys(i["variable_name"] for i in self.possible_interpretations if i.get("variable_name")))

    @property
    def ambiguous_shape(self) -> str:
        return " ".join([*self.symbol_sequence, "•", self.conflicting_lookahead])

    def to_json(self) -> dict[str, Any]:
        return {
            "symbol_sequence": list(self.symbol_sequence),
            "conflicting_lookahead": self.conflicting_lookahead,
            "possible_interpretations": list(self.possible_interpretations),
            "possible_resolutions": list(self.possible_resolutions),
        }


class GrammarConflictError(GenerateError):
    """A conflict that the grammar neither settles nor declares, with the lines of the rules that take part."""

    def __init__(self, conflict: Conflict, grammar: GrammarModel | None = None):
        self.conflict, self.grammar = conflict, grammar
        sites = grammar.sites if grammar else {}
        self.sites = {rule: sites.get(rule) for rule in conflict.involved_rules}
        lines = [f"unresolved conflict: {conflict.ambiguous_shape}"]
        for way in conflict.possible_interpretations:
            steps = list(way.get("production_step_symbols", ()))
            at = way.get("step_index", len(steps))
            site = production_site(grammar, way.get("variable_name"), steps)
            lines.append(f"  {way.get('variable_name')} -> {' '.join([*steps[:at], '•', *steps[at:]])}" + (f" at {site}" if site else ""))
        lines += [f"  {rule} at {site}" for rule, site in self.sites.items() if site]
        self.fixes = [suggestion(r) for r in conflict.possible_resolutions]
        super().__init__("\n".join(lines + [f"  fix: {f}" for f in self.fixes]))


def production_site(grammar: GrammarModel | None, rule: str | None, symbols: list[str]) -> Site | None:
    """Where the alternative of a rule was written that gives a production, or else where the rule was."""
    from .dsl import matching_alternative

    if grammar is None or rule not in grammar.rules:
        return None
    found = matching_alternative(grammar.rules[rule], symbols)
    return (found.site if found is not None else None) or grammar.sites.get(rule)


def suggestion(resolution: dict[str, Any]) -> str:
    names = ", ".join(map(str, resolution.get("symbols", ())))
    return {
        "Precedence": f"give one of {names} a higher precedence",
        "Associativity": f"give {names} a left or right associativity",
        "AddConflict": f"declare the conflict of {names}",
    }.get(str(resolution.get("type")), f"{resolution.get('type')}: {names}")


def balanced_objects(text: str):
    """JSON objects that stand anywhere in a text, in order; braces inside strings do not count."""
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            found, end = decoder.raw_decode(text, at)
            yield found
            at = text.find("{", end)
        except ValueError:
            at = text.find("{", at + 1)


def parse_conflict_json(text: str) -> Conflict | None:
    """The conflict in a builder's error output, or None if it holds none."""
    for found in balanced_objects(text):
        inner: Any = found
        for key in CONFLICT_KEY:
            inner = inner.get(key) if isinstance(inner, dict) else None
        if isinstance(inner, dict):
            return Conflict(
                tuple(inner.get("symbol_sequence", ())),
                str(inner.get("conflicting_lookahead", "")),
                tuple(inner.get("possible_interpretations", ())),
                tuple(inner.get("possible_resolutions", ())),
            )
        return None
    return None
