"""Corpora: texts with the trees they should have."""

from __future__ import annotations

import difflib
import sys
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grammar.build import BuildResult, build
from ..grammar.dsl import Grammar
from ..language import Language
from .render import STYLES, rendered, select_node


@dataclass(frozen=True)
class Case:
    source: str
    expected: str
    name: str = ""
    selector: str | None = None
    site: str = ""


def corpus_case(source: str, expected: str, name: str = "", selector: str | None = None) -> Case:
    frame = sys._getframe(1)
    return Case(source, expected, name or source, selector, f"{frame.f_code.co_filename}:{frame.f_lineno}")


@dataclass
class CorpusResult:
    total: int
    failures: list[tuple[Case, str]] = field(default_factory=list)

    def ok(self) -> bool:
        return not self.failures

    def report(self) -> str:
        lines = [f"{self.total - len(self.failures)} of {self.total} cases passed"]
        for case, got in self.failures:
            lines.append(f"{case.name} ({case.site})" if case.site else case.name)
            lines += difflib.unified_diff([case.expected], [got], "expected", "got", lineterm="")
        return "\n".join(lines)


class Corpus:
    def __init__(self, cases: Iterable[Case | tuple], name: str = "", style: str = "sexp"):
        self.cases = [c if isinstance(c, Case) else Case(*c) for c in cases]
        self.name, self.style = name, style

    def run(self, *, grammar: Grammar | None = None, language: Language | None = None, build_result: BuildResult | None = None, scanner: str | None = None, snapshots_dir: str | Path | None = None) -> CorpusResult:
        """Parses each case on the driver and compares."""
        if language is None:
            build_result = build_result or build(grammar, scanner=scanner)
            language = build_result.language()
        if snapshots_dir is not None and build_result is not None:
            folder = Path(snapshots_dir)
            folder.mkdir(parents=True, exist_ok=True)
            build_result.model.emit_json(folder / "grammar.json")
            build_result.schema.write(folder / "node-schema.json")
        out = CorpusResult(len(self.cases))
        for case in self.cases:
            node = select_node(language.parse(case.source), case.selector)
            got = "" if node is None else STYLES[self.style](node)
            if " ".join(got.split()) != " ".join(case.expected.split()):
                out.failures.append((case, got))
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c.name, c.source, c.expected, c.selector) for c in self.cases], "name string, text string, expected string, selector string")


def failing(cases: DataFrame, language: Language, *, style: str = "sexp", selector: str | None = None) -> DataFrame:
    """Of cases(name, text, expected), those whose tree is another one."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    got = rendered(cases, language, style=style, selector=selector)
    return got.where(~squeeze(F.coalesce("rendered", F.lit(""))).eqNullSafe(squeeze(F.col("expected"))))
