"""A model's query in the usual notation of tree patterns, for people to read."""

from __future__ import annotations

import json

from ..model import GAP, AnyOf, Eq, ExtractSpec, Matches


def _test(name: str, test) -> str:
    if isinstance(test, Matches):
        return f"(#match? @{name} {json.dumps(test.regex)})"
    if isinstance(test, Eq):
        return f"(#eq? @{name} {json.dumps(test.value)})"
    assert isinstance(test, AnyOf)
    return f"(#any-of? @{name} {' '.join(json.dumps(v) for v in test.values)})"


def pattern_text(spec: ExtractSpec, kinds: dict[str, tuple[str, ...]] | None = None) -> str:
    if spec.raw is not None:
        return spec.raw
    kinds, parts = kinds or {}, []
    for b in spec.captures:
        allowed = kinds.get(b.name) or b.kinds
        shown = " ".join(f"({k})" for k in allowed) if allowed else "(_)"
        shown = f"[{shown}]" if len(allowed) > 1 else shown
        mark = "" if b.required else "*" if b.is_list else "?"
        lead = "" if b.source == "kind" else f"{json.dumps(b.key) if b.source == 'key' else b.key}: "
        parts.append(" ".join([f"{lead}{f'({b.key})' if b.source == 'kind' else shown}{mark} @{b.name}", *(_test(b.name, t) for t in b.predicates)]))
    inner = " ".join([*parts, "@_anchor"])
    text = ""
    for step in reversed(spec.path.steps):
        if step == GAP:
            text = f"... {text}"
            continue
        name = f"[{' '.join(step)}]" if len(step) > 1 else step[0]
        text = f"({name} {text})" if text else f"({name} {inner})"
    return ("; record\n" if spec.record else "") + text
