"""Extraction over streams of documents.

``extract_stream`` is stateless: each arriving version of a document gives its rows. ``extract_changes`` keeps, for each
document, a hash of its last text, and parses a version only if it differs from the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..language import Extractor


def extract_stream(docs: DataFrame, extractor: Extractor) -> DataFrame:
    """A streaming DataFrame (doc_id, text, ...) to a streaming DataFrame of rows."""
    return extractor.extract(docs)


def changed_versions(docs: DataFrame, doc: str = "doc_id", text: str = "text", ts: str | None = None) -> DataFrame:
    """Of a stream of versions, those whose text differs from the last one of the same document.

    The state of a document is one hash. Versions of one trigger are taken in the order of ``ts`` if there is one.
    """
    types = {f.name: f.dataType for f in docs.schema}
    out = f"{doc} {types[doc].simpleString()}, {text} string"

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches))
        rows = rows.sort_values(ts) if ts else rows
        kept = []
        for value, mark in zip(rows[text], rows["_mark"]):
            if mark != last:
                kept.append(value)
                last = mark
        if last is not None:
            state.update((int(last),))
        yield pd.DataFrame({doc: [key[0]] * len(kept), text: kept})

    marked = docs.select(doc, text, *([ts] if ts else []), F.xxhash64(text).alias("_mark"))
    return marked.groupBy(doc).applyInPandasWithState(step, out, "mark long", "append", GroupStateTimeout.NoTimeout)


def extract_changes(docs: DataFrame, extractor: Extractor, doc: str = "doc_id", text: str = "text", ts: str | None = None) -> DataFrame:
    """Rows of each version that changed."""
    return extractor.extract(changed_versions(docs, doc, text, ts))


def replayed(extract: Callable[[DataFrame], DataFrame], stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream to its end (availableNow) into parquet files."""
    extract(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
