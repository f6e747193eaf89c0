"""Documents that change while a stream runs: each version is parsed from the tree of the one before.

The state of a document is its last text, the places from which the parser can go on, and the tree, one list entry for each
top-level node. A version that arrives is compared with the text in the state, parsed from the last such place before the change to the
first one behind it at which the parser stands as it did, and the nodes around that are taken from the state, frozen as they are. Versions
have numbers that follow each other; one that comes too early is held in the state until its turn. The versions of a trigger are put in order
in memory, some thousands at a time, and only what is then still too early goes to the state, in groups of neighbouring numbers. The state
of a document that does not change for ``ttl`` is dropped.

Cost of a version: the text is read and compared, what changed is parsed and frozen; once a trigger the list of top-level nodes is written
again. Memory of a task is one document with its tree, its versions up to AT_ONCE, and one group of those held.

Defined results for odd input: a null text takes the document away (its versions go on counting); a version number that was had already, or a
null one, is left out; of several rows with one number any one counts; null keys are one document; an empty text is a version like any other.
A gap that is not filled within ``patience`` is given up: the least version that is held comes next.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..grammar.scanners import scanner_for
from ..language import Extractor, Language
from ..parse.frozen import FrozenShapes, Reparser, frozen_marks, frozen_root, thawed
from ..parse.rows import ARROW, COLUMNS, Wanted, parse_batches
from ..parse.runtime import Parser
from ..plans import captured

#: The state store that this kind of operator needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000
#: Versions of a document that are put in order in memory: so many, of so many characters.
AT_ONCE = 4096, 8 << 20
#: Neighbouring numbers of versions that are held together.
GROUP = 256
#: A group of versions of at most so many characters is held beside the tree, others in a map.
BESIDE = 1 << 16


_parsers: dict[str, Reparser] = {}


class _Taken(Row):
    """A row of values that hold no rows."""

    def asDict(self, recursive: bool = False) -> dict[str, Any]:
        return dict(zip(self.__fields__, self))


class _Versions(StatefulProcessor):
    """Carries the tables itself: the worker beside the driver that looks at a processor has no broadcasts."""

    def __init__(self, language: Language, first: int, ttl: int, patience: int):
        self.tables, self.scanner, self.name = language.tables, language.scanner, uuid.uuid4().hex
        self.first, self.ttl, self.patience = first, ttl, patience

    def parser(self) -> Reparser:
        if self.name not in _parsers:
            _parsers.clear()
            _parsers[self.name] = Reparser(Parser(self.tables, scanner_for(self.scanner) if self.scanner else None))
        return _parsers[self.name]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "version long, text string, root string, marks string, nodes string, held string, timer boolean", self.ttl)
        self.ahead = handle.getMapState("ahead", "part long", "versions string", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        done, some, size = _Document(self), {}, 0
        for row in rows:
            number, text = row["version"], row["text"]
            if number is None or number < done.next:
                continue
            some.setdefault(number, text)
            size += len(text or "")
            if len(some) >= AT_ONCE[0] or size >= AT_ONCE[1]:
                yield from done.taken(key, some)
                some, size = {}, 0
        yield from done.taken(key, some)
        self._wait(done, timerValues)
        done.keep()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        done = _Document(self)
        done.timer, done.changed = False, True
        least = done.least_held()
        if least is not None:
            done.next = least
            yield from done.taken(key, {})
            self._wait(done, timerValues)
        done.keep()

    def _wait(self, done: _Document, timers: Any) -> None:
        """A timer for the versions that are still held, if there is none."""
        if done.parts and not done.timer:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.patience)
            done.timer = done.changed = True

    def close(self) -> None:
        pass


def _numbered(versions: dict[str, str | None]) -> dict[int, str | None]:
    return {int(n): t for n, t in versions.items()}


class _Document:
    """The document of a key while its rows are worked on. A call of the state costs more than a version, so one value has all but held versions."""

    def __init__(self, of: _Versions):
        self.of, self.tree, self.changed = of, None, False
        self.part: int | None = None  # the group at hand, and its versions
        self.versions: dict[int, str | None] = {}
        held = of.last.get()
        self.next = of.first if held is None else held[0] + 1
        self.held = held if held is not None and held[1] is not None else None
        # Groups in the state: the versions of one, which is held beside the tree; None for those in the map.
        self.parts: dict[int, dict | None] = {} if held is None else {int(part): v and _numbered(v) for part, v in json.loads(held[5]).items()}
        self.timer = held is not None and held[6]

    def _old(self) -> Any:
        if self.tree is None and self.held is not None:
            _, text, root, marks, nodes, _, _ = self.held
            # A frozen node has no line breaks.
            self.tree = thawed(root, nodes.split("\n") if nodes else [], text, marks, kept=True)
        return self.tree

    def take(self, key: Any, text: str | None) -> Row:
        number, parser = self.next, self.of.parser()
        old, self.next, self.changed, self.held = self._old(), number + 1, True, None
        if text is None:
            self.tree, tree, parsed = None, None, 0
        else:
            self.tree = parser.parse(text) if old is None else parser.reparse(old, text)
            parsed, tree = self.tree.parsed, [frozen_root(self.tree), *(n.frozen for _, n in self.tree.children)]
        return _Taken(doc=key[0], version=number, text=text, tree=tree, parsed_chars=parsed)

    def taken(self, key: Any, some: dict[int, str | None]) -> Iterator[Row]:
        """Versions in their order as far as they go, with those that were held; the others are held."""
        while True:
            if self.next in some:
                text = some.pop(self.next)
            elif (self.part == self.next // GROUP or self.next // GROUP in self.parts) and self.next in self._group(self.next // GROUP):
                text = self.versions[self.next]
            else:
                break
            yield self.take(key, text)
        by_part: dict[int, list[int]] = {}
        for number in some:
            if number >= self.next:
                by_part.setdefault(number // GROUP, []).append(number)
        for part in by_part:
            group = self._group(part)
            for number in by_part[part]:
                group.setdefault(number, some[number])
        self._put()

    def _group(self, part: int) -> dict[int, str | None]:
        """The held versions of a group, brought to hand; the one before is put back."""
        if self.part != part:
            self._put()
            self.part, self.versions = part, self.parts.get(part) or {}
            if part in self.parts and self.parts[part] is None:
                held = self.of.ahead.getValue((part,))
                self.versions = {} if held is None else _numbered(json.loads(held[0]))
        return self.versions

    def _put(self) -> None:
        """Writes the group at hand without what has had its turn."""
        if self.part is None:
            return
        left = {n: t for n, t in self.versions.items() if n >= self.next}
        mapped = self.part in self.parts and self.parts.pop(self.part) is None
        if left and sum(len(t or "") for t in left.values()) <= BESIDE and not any(self.parts.values()):
            self.parts[self.part] = left
        elif left:
            self.of.ahead.updateValue((self.part,), (json.dumps(left),))
            self.parts[self.part] = None
        if mapped and self.parts.get(self.part, left) is not None:
            self.of.ahead.removeKey((self.part,))
        self.changed = True
        self.part, self.versions = None, {}

    def least_held(self) -> int | None:
        for part in sorted(self.parts):
            held = [n for n in self._group(part) if n >= self.next]
            if held:
                return min(held)
        return None

    def keep(self) -> None:
        if not self.changed:
            return
        self._put()
        rest, tree = (json.dumps(self.parts), self.timer), self._old()
        if tree is None:
            self.of.last.update((self.next - 1, None, None, None, None, *rest))
        else:
            self.of.last.update((self.next - 1, tree.source, frozen_root(tree), frozen_marks(tree), "\n".join(n.frozen for _, n in tree.children), *rest))


def reparsed(docs: DataFrame, language: Language, doc: str = "doc_id", version: str = "version", text: str = "text", first: int = 1, ttl: int = 30 * DAY, patience: int = DAY) -> DataFrame:
    """A stream of versions (doc, version, text) to a stream of their trees: doc, version, text, tree (frozen) and parsed_chars, the
    characters that were parsed for it. Needs PROVIDER as spark.sql.streaming.stateStore.providerClass."""
    kind = docs.schema[doc].dataType
    schema = T.StructType([T.StructField("doc", kind), T.StructField("version", T.LongType()), T.StructField("text", T.StringType()), T.StructField("tree", T.ArrayType(T.StringType())), T.StructField("parsed_chars", T.LongType())])
    rows = docs.select(F.col(doc).alias("doc"), F.col(version).cast("long").alias("version"), F.col(text).alias("text"))
    processor = _Versions(language, first, ttl, patience)
    return rows.groupBy("doc").transformWithState(processor, schema, "Append", "ProcessingTime").withColumnRenamed("doc", doc)


def version_nodes(versions: DataFrame, want: Wanted | None = None, carried: list[str] | None = None) -> DataFrame:
    """The nodes relation of reparsed versions: the carried columns (all but text and tree), then COLUMNS of parse.rows."""
    return _relation(versions, want or Wanted(), carried, COLUMNS, None)


def version_captures(versions: DataFrame, extractor: Extractor) -> DataFrame:
    """Rows of plans.captured of reparsed versions, for a model that it serves."""
    form = captured.Form.of(extractor.checked)
    return _relation(versions, extractor.wanted(), None, form.schema, form)


def _relation(versions: DataFrame, wanted: Wanted, carried: list[str] | None, columns: str, form: captured.Form | None) -> DataFrame:
    carried = [c for c in versions.columns if c not in ("text", "tree")] if carried is None else carried
    taken = {n for n, _ in ARROW} & set(carried)
    if taken:
        raise ValueError(f"columns named like those of nodes: {sorted(taken)}")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in versions.select(*carried).schema), columns])
    tree_of = lambda text, tree: thawed(tree[0], tree[1:], text)
    made = lambda: None if form is None else form.made()
    return versions.select(*carried, "text", "tree").mapInArrow(lambda batches: parse_batches(batches, tree_of, wanted, carried, FrozenShapes().find, made()), schema)


def extract_versions(versions: DataFrame, extractor: Extractor) -> DataFrame:
    """The model's rows of reparsed versions, without parsing: doc, version and parsed_chars, then the model's columns."""
    if not captured.serves(extractor.checked):
        return extractor.extract_nodes(version_nodes(versions, extractor.wanted()))
    return extractor.extract_captured(version_captures(versions, extractor), [c for c in versions.columns if c not in ("text", "tree")])


def replay(versions: DataFrame, folder: str, language: Language, files_a_trigger: int = 2, **options: int) -> DataFrame:
    """Runs a table (doc_id, version, text) through the stream, some files a trigger, and returns the reparsed versions; folder takes the
    input, the output and the state. For tests and for catching up on what has gathered: the stream ends with its input, so versions
    behind a gap stay held."""
    spark = versions.sparkSession
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    # Timers ask for one batch after the other; a stream that ends with its input would not end.
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    versions.write.mode("append").parquet(f"{folder}/in")
    arriving = own.readStream.schema(versions.schema).option("maxFilesPerTrigger", files_a_trigger).parquet(f"{folder}/in")
    stream = reparsed(arriving, language, **options).writeStream.format("parquet").option("path", f"{folder}/out")
    stream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")
