"""Ranked lexical search by TPUT (three-phase uniform threshold, Cao and Wang 2004) over term-partitioned postings.

Documents become a forward index (each document's queried terms with their counts), and that the postings: for each term a list of (document,
score) with the highest scores first, kept in blocks of up to RANGE documents and partitioned by term; long lists are cut into
pieces, so a term that every document holds is spread over the cluster.

1. Every list gives its head, the TOP highest entries. Their sums bound the TOP-th score of an item from below; exact scores of the same documents,
   looked up in the forward index, bound it far better.
2. The bound by sums, divided by the item's number of lists, is one threshold for all of them: whoever lies below it everywhere has a total below
   the bound. Each list sends its entries above the least threshold of all items that ask it, as a packed prefix of each block,
   to the coordinator of the block's documents. There partial sums, and what the lists not seen could add at most, give
   a better bound and the candidates that can still reach it.
3. Exact scores of the candidates are looked up in the forward index.

All arithmetic is in integers, and a document below a bound is strictly below the TOP-th score, so ties are never cut.

Memory: a coordinator holds one range of documents and the lists' prefixes in it. Items are handled in blocks of some BLOCK_BYTES of text, whose
words, thresholds and ids are all that is sent to every task.

Defined results for odd input: null and empty texts have no terms and never rank; an item without terms has no rows; rows of the
benchmark are items of their own, even with equal ids; a null doc_id comes after all others of equal score; repeated documents rank
each by itself; further columns are ignored; texts of any length are used whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import written

TOP = 10
#: Documents that share a coordinator.
RANGE = 1 << 14
#: Text of items that are searched together, in bytes.
BLOCK_BYTES = 4 << 20

#: Every byte of a text with A-Z in lower case, and a space for those that are in no term.
_TERMS = bytes(b if tk.ALNUM_WORD[b] else 32 for b in tk.lowered(np.arange(256, dtype=np.uint8)).tolist())

_FORWARD = "row long, doc_id long, n long, terms binary, counts binary"
_POSTINGS = "term int, range long, docs binary, scores binary, head binary"
_POSTINGS_ARROW = pa.schema([("term", pa.int32()), ("range", pa.int64()), ("docs", pa.binary()), ("scores", pa.binary()), ("head", pa.binary())])
RESULT = "item_id long, rank int, doc_id long, score long"
#: In place of a term: the row ids of the documents of a range.
_ROWS = -1


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The m of documents of n terms each."""
    if len(n) and 75 * int(n.max()) * documents >= 1 << 63:
        return np.array([25 + (75 * x * documents) // terms for x in n.tolist()], np.int64)
    return 25 + (75 * n.astype(np.int64) * documents) // terms


def scores(weights: np.ndarray, counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = counts.astype(np.int64)
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Items:
    """A block of items: their ids, and for each its terms (numbers in the block's vocabulary) with repeats counted."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        found = [Counter(terms_of((t or "").encode())) for t in texts]
        self.vocabulary = {w: k for k, w in enumerate(sorted(set().union(*found)))}
        self.ids = ids
        self.terms = [np.array(sorted(self.vocabulary[w] for w in one), np.int64) for one in found]
        times = [{self.vocabulary[w]: n for w, n in one.items()} for one in found]
        self.times = [np.array([one[t] for t in ts.tolist()], np.int64) for one, ts in zip(times, self.terms)]

    def acting(self, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, repeats) of each item whose lists can add something."""
        return [(t[weights[t] > 0], q[weights[t] > 0]) for t, q in zip(self.terms, self.times)]


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row for each of docs(doc_id, text): its number, its terms with repeats, and those of the vocabulary with their counts."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, row = known.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b, data, offsets in tk.chunks(batch.column(1)):
                raw, at = data.tobytes(), offsets.tolist()
                sizes, terms, counts = [], [], []
                for x, y in zip(at[:-1], at[1:]):
                    found = terms_of(raw[x:y])
                    sizes.append(len(found))
                    seen = Counter(found)
                    held = sorted((words[w], seen[w]) for w in seen.keys() & words.keys())
                    terms.append(np.array([t for t, _ in held], "<i4").tobytes())
                    counts.append(np.array([c for _, c in held], "<i4").tobytes())
                columns = [pa.array(np.arange(row, row + b - a)), batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())]
                row += b - a
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(count, _FORWARD)


def corpus_counts(forward: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and the documents that hold each of the vocabulary's terms."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents, total = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            n = batch.column(0).to_numpy()
            documents, total = documents + int((n > 0).sum()), total + int(n.sum())
            held += np.bincount(np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4"), minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some.tolist()], pa.int64()), pa.array([total, documents, *held[some].tolist()], pa.int64())], names=["term", "n"])

    found = forward.select("n", "terms").mapInArrow(add, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts = dict(zip(found["term"].to_pylist(), found["n"].to_pylist()))
    return counts.get(-1, 0), counts.get(-2, 0), np.array([counts.get(t, 0) for t in range(size)], np.int64)


def postings(forward: DataFrame, weights: np.ndarray, documents: int, total: int, top: int = TOP, reach: int = RANGE) -> DataFrame:
    """The lists, in blocks: (term, range, docs, scores, head), highest scores first; docs are places in the range's row ids, which
    travel under the term _ROWS; head has the row ids of the first entries."""
    shared = forward.sparkSession.sparkContext.broadcast(weights)

    def blocks(name: int, rows: list[np.ndarray], n: list[np.ndarray], terms: list[bytes], counts: list[bytes]) -> pa.RecordBatch:
        size = np.fromiter(map(len, terms), np.int64, len(terms)) // 4
        term, tf = (np.frombuffer(b"".join(x), "<i4") for x in (terms, counts))
        doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        score = scores(shared.value[term], tf, lengths(np.concatenate(n), documents, total)[doc])
        some = score > 0
        term, doc, score = term[some], doc[some], score[some]
        order = np.lexsort((doc, -score, term))
        row = np.concatenate(rows)
        row_of, term, doc, score = row[doc[order]].astype("<i8").tobytes(), term[order], doc[order].astype("<i4").tobytes(), score[order].astype("<i8").tobytes()
        edges = [0, *(np.flatnonzero(np.diff(term)) + 1).tolist(), len(term)] if len(term) else [0]
        names = [_ROWS, *term[edges[:-1]].tolist()]
        heads = [b"", *(row_of[8 * a : 8 * min(b, a + top)] for a, b in zip(edges[:-1], edges[1:]))]
        docs = [row.astype("<i8").tobytes(), *(doc[4 * a : 4 * b] for a, b in zip(edges[:-1], edges[1:]))]
        marks = [b"", *(score[8 * a : 8 * b] for a, b in zip(edges[:-1], edges[1:]))]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([name] * len(names), pa.int64()), pa.array(docs, pa.binary()), pa.array(marks, pa.binary()), pa.array(heads, pa.binary())], schema=_POSTINGS_ARROW)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, count = TaskContext.get().partitionId() << 20, ([], [], [], []), 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, reach - count)
                at, count = at + part.num_rows, count + part.num_rows
                held[0].append(part.column(0).to_numpy())
                held[1].append(part.column(1).to_numpy())
                held[2].extend(part.column(2).to_pylist())
                held[3].extend(part.column(3).to_pylist())
                if count == reach:
                    yield blocks(name, *held)
                    name, held, count = name + 1, ([], [], [], []), 0
        if count:
            yield blocks(name, *held)

    made = forward.select("row", "n", "terms", "counts").mapInArrow(make, _POSTINGS)
    # A list's piece: the ranges that sixteen tasks made.
    return made.repartition("term", F.shiftright("range", 24)).sortWithinPartitions("term", "range")


def _best(rows: DataFrame, top: int, key: str, *order) -> DataFrame:
    """The first rows of each key; tasks keep no more than that of a key before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= top)


def _bounds(sums: DataFrame, value: str, items: int, top: int) -> np.ndarray:
    """The top-th highest value of each item; 0 where there are fewer."""
    best = _best(sums, top, "item", F.col(value).desc()).groupBy("item").agg(F.count("*").alias("n"), F.min(value).alias("least"))
    out = np.zeros(items, np.int64)
    for row in best.where(F.col("n") == top).collect():
        out[row.item] = row.least
    return out


def in_heads(lists: DataFrame, acting: list[tuple[np.ndarray, np.ndarray]], top: int = TOP) -> DataFrame:
    """Phase 1: (item, row, sum) of the documents at the heads of an item's lists, with the sum of their entries there."""
    item = np.repeat(np.arange(len(acting)), [len(t) for t, _ in acting])
    asks = lists.sparkSession.createDataFrame(pa.table({"item": item, "term": np.concatenate([t for t, _ in acting]).astype(np.int32), "times": np.concatenate([q for _, q in acting])}))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = batch.column(2).to_pylist()
            size = np.fromiter(map(len, heads), np.int64, len(heads)) // 8
            marks = [x.as_buffer()[: len(h)].to_pybytes() for x, h in zip(batch.column(1), heads)]
            columns = [np.repeat(batch.column(0).to_numpy(), size), np.frombuffer(b"".join(heads), "<i8"), np.frombuffer(b"".join(marks), "<i8")]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["term", "row", "score"])

    heads = lists.where(F.col("term") != _ROWS).select("term", "scores", "head").mapInArrow(cut, "term int, row long, score long")
    return _best(heads, top, "term", F.col("score").desc(), "row").drop("rank").join(asks, "term").groupBy("item", "row").agg(F.sum(F.col("score") * F.col("times")).alias("sum"))


def candidates(lists: DataFrame, acting: list[tuple[np.ndarray, np.ndarray]], bounds: np.ndarray, size: int, top: int = TOP, known: np.ndarray | None = None) -> DataFrame:
    """Phase 2: (item, row, sum, most) of documents whose greatest possible score reaches what is known of their range and, by ``known``
    (lower bounds, too), of all. The lists' threshold comes from ``bounds``: a lower one sends more entries, but leaves less open of each document."""
    # An entry s of a term asked q times by an item of k lists is sent if s * q * k >= bound.
    wanted = [np.maximum(1, -(-int(b) // (q * max(1, len(t))))) for (t, q), b in zip(acting, bounds)]
    least = np.full(size, np.iinfo(np.int64).max)
    for (t, _), low in zip(acting, wanted):
        np.minimum.at(least, t, low)
    unseen = [max(0, (int(b) - 1) // max(1, len(t))) for (t, _), b in zip(acting, bounds)]
    shared = lists.sparkSession.sparkContext.broadcast((acting, wanted, unseen, least, bounds if known is None else np.maximum(bounds, known)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = shared.value[3]
        for batch in batches:
            keep, docs, marks = [], [], []
            for k, term in enumerate(batch.column(0).to_pylist()):
                if term == _ROWS:
                    keep.append(k), docs.append(batch.column(2)[k].as_py()), marks.append(b"")
                    continue
                values = np.frombuffer(batch.column(3)[k].as_buffer(), "<i8")
                n = int(np.searchsorted(-values, -least[term], side="right"))
                if n:
                    keep.append(k), docs.append(batch.column(2)[k].as_buffer()[: 4 * n].to_pybytes()), marks.append(values[:n].tobytes())
            chosen = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen), pa.array(docs, pa.binary()), pa.array(marks, pa.binary())], names=["term", "range", "docs", "scores"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, dict]]:
        name, rows, found = None, None, {}
        for batch in batches:
            for term, range_, docs, marks in zip(*(c.to_pylist() for c in batch.columns)):
                if range_ != name:
                    if name is not None:
                        yield rows, found
                    name, found = range_, {}
                if term == _ROWS:
                    rows = np.frombuffer(docs, "<i8")
                else:
                    found[term] = np.frombuffer(docs, "<i4"), np.frombuffer(marks, "<i8")
        if name is not None:
            yield rows, found

    def coordinate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acting, wanted, unseen, _, bounds = shared.value
        for rows, found in ranges(batches):
            out = []
            for item, (terms, times) in enumerate(acting):
                total, seen = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                for term, q, low in zip(terms.tolist(), times.tolist(), wanted[item].tolist()):
                    if term in found:
                        docs, values = found[term]
                        n = int(np.searchsorted(-values, -low, side="right"))
                        total[docs[:n]] += q * values[:n]
                        seen[docs[:n]] += 1
                some = np.flatnonzero(seen)
                if not len(some):
                    continue
                total = total[some]
                most = total + (len(terms) - seen[some]) * unseen[item]
                bound = np.partition(total, -top)[-top] if len(some) >= top else 0
                stays = most >= max(bound, bounds[item])
                out.append((np.full(int(stays.sum()), item), rows[some[stays]], total[stays], most[stays]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["item", "row", "sum", "most"])

    sent = lists.drop("head").mapInArrow(send, "term int, range long, docs binary, scores binary").repartition("range").sortWithinPartitions("range", "term")
    return sent.mapInArrow(coordinate, "item long, row long, sum long, most long")


def exact_scores(chosen: DataFrame, forward: DataFrame, acting: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, total: int) -> DataFrame:
    """Phase 3: (item, doc_id, score) of candidates(item, row), looked up in the forward index."""
    shared = forward.sparkSession.sparkContext.broadcast((acting, weights))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acting, weights = shared.value
        for batch in batches:
            m, out = lengths(batch.column(2).to_numpy(), documents, total), []
            for item, terms, counts, one in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), m.tolist()):
                asked, times = acting[item]
                held, tf = np.frombuffer(terms, "<i4"), np.frombuffer(counts, "<i4")
                _, a, b = np.intersect1d(asked, held, assume_unique=True, return_indices=True)
                out.append(int((times[a] * scores(weights[asked[a]], tf[b], np.int64(one))).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["item", "doc_id", "score"])

    joined = chosen.join(forward, "row").select("item", "doc_id", "n", "terms", "counts")
    return joined.mapInArrow(look, "item long, doc_id long, score long")


def _searched(docs: DataFrame, items: Items, top: int, reach: int) -> DataFrame | None:
    """(item_id, rank, doc_id, score) of one block of items."""
    if not items.vocabulary:
        return None
    forward = written(forward_index(docs, items.vocabulary), "forward")
    documents, total, held = corpus_counts(forward, len(items.vocabulary))
    if not documents:
        return None
    weights = np.array([weight(documents, n) if n else 0 for n in held.tolist()], np.int64)
    acting = items.acting(weights)
    if not any(len(t) for t, _ in acting):
        return None
    lists = written(postings(forward, weights, documents, total, top, reach), "postings")
    heads = written(in_heads(lists, acting, top), "heads")
    # Sums of the entries at the heads for the threshold, exact scores of the same documents for what can be left out.
    bounds = _bounds(heads, "sum", len(acting), top)
    known = _bounds(exact_scores(heads.select("item", "row"), forward, acting, weights, documents, total), "score", len(acting), top)
    found = written(candidates(lists, acting, bounds, len(weights), top, known), "partial-sums")
    better = pa.table({"item": np.arange(len(acting)), "bound": np.maximum(known, _bounds(found, "sum", len(acting), top))})
    spark = docs.sparkSession
    chosen = found.join(F.broadcast(spark.createDataFrame(better)), "item").where("most >= bound").select("item", "row")
    scored = exact_scores(chosen, forward, acting, weights, documents, total).where("score > 0")
    best = _best(scored, top, "item", F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    names = spark.createDataFrame(pa.table({"item": np.arange(len(items.ids)), "item_id": pa.array(items.ids, pa.int64())}))
    return best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP, reach: int = RANGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The top documents of each item, by score and then doc_id."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, out = size // block_bytes + 1, None
    numbered = items.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))
    for k in range(blocks):
        block = numbered.where(F.col("block") == k).toArrow()
        found = _searched(docs, Items(block["item_id"].to_pylist(), block["text"].to_pylist()), top, reach)
        if found is not None:
            found = written(found, "ranked") if blocks > 1 else found
            out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], RESULT) if out is None else out
