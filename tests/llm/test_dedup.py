"""Deduplication operators against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F
import xxhash

from syntaxframe.llm import components, line_dedup, simhash, substring_dedup
from syntaxframe.llm import textkit as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Substring dedup.


def plain_removed(rows):
    first = {}
    words = [(i if i is not None else 1 << 63, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    out = []
    for (doc, _), (i, w) in zip(rows, words):
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_repeated_windows_against_brute_force(spark):
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(None, passage), (7, passage), (7, passage), (7, "x " + passage), (3, None), (4, ""), (5, "a " * 40)]
    for i in range(60):
        head, tail = (" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.choice([3, 30]))) for _ in range(2))
        cut = rng.randint(0, 200)
        rows.append((100 + i, f"{head}\n{passage[cut:]}\t{tail} " + "a " * rng.choice([0, 30])))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bucket string").repartition(3)
    got = substring_dedup.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == plain_removed(rows)
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


def test_buckets_drop_what_has_lost_as_they_grow(monkeypatch):
    rng = random.Random(31)
    passage, texts = " ".join(f"p{k}" for k in range(30)), []
    for i in range(120):
        own = " ".join(rng.choice("abcdefgh") for _ in range(40))
        texts.append((i, f"{own} {passage}" if i % 2 else own))
    none = np.zeros(0, np.uint64)
    packs = []
    for row in rng.sample(texts, len(texts)):
        batch = pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.array([row[1]])], names=["doc_id", "text"])
        packs += [b.filter(pa.compute.is_valid(b.column(1))) for b in substring_dedup._packs(iter([batch]), none, 1)]

    def spans(limit):
        monkeypatch.setattr(substring_dedup, "COMPACT_BYTES", limit)
        out, most = set(), 0
        plain = substring_dedup._marked
        sizes = []
        monkeypatch.setattr(substring_dedup, "_marked", lambda held, keep=False: (sizes.append(len(held)), plain(held, keep))[1])
        for b in substring_dedup._settle(iter(packs)):
            for i, k, a, z in zip(*(c.to_pylist() for c in b.columns)):
                out |= {(i, k, w) for w in range(a, z)}
        monkeypatch.setattr(substring_dedup, "_marked", plain)
        return out, len(sizes)

    whole, once = spans(1 << 30)
    parts, many = spans(2000)
    assert whole == parts and once == 1 and many > 5 and whole


def test_windows_with_one_hash_are_told_apart():
    hashes, ids = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 3, 4])
    text = np.array(["a", "b", "a", "c"])
    lost = substring_dedup.beaten(hashes, ids, lambda x, y: text[x] == text[y])
    assert lost.tolist() == [False, False, True, False]


# SimHash.


def plain_print(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = WORD.findall(text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts():
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60)) for _ in range(12)]
    rows = [(None, base[0]), (4, ""), (9, None), (2, " "), (11, "One"), (12, "one two")]
    for i in range(80):
        words = base[rng.randrange(len(base))].split()
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "z"
        rows.append((100 + i, " ".join(words)))
    return rows


def plain_components(rows):
    prints = [plain_print(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2 and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), g in zip(rows, label):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted(((i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(rows, prints, label)), key=str), len(set(label))


def test_near_duplicates_against_brute_force(spark):
    rows = near_texts()
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, print int, _row int, root int")
    expected, groups = plain_components(rows)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == expected
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == groups
    assert {r.doc_id for r in kept.collect()} <= {c for _, _, c in expected} | {None}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def plain_shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_documents_of_similar_shingles_are_one_group(spark):
    rng = random.Random(12)
    rows = [(None, "One two"), (1, "one  TWO"), (2, None), (3, ""), (4, "x y z")]
    for i in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        for k in range(6):
            words = list(base)
            for j in rng.sample(range(0, 100, 10), k % 4):
                words[j] = f"v{rng.randrange(10**6)}"
            rows.append((10 + 6 * i + k, " ".join(words)))
    sets, prints = [plain_shingles(t) for _, t in rows], [plain_print(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            near = sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 2
            if near and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), g in zip(rows, label):
        i = 1 << 63 if i is None else i
        least[g] = min(least.get(g, i), i)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in simhash.one_of_each(docs, share=0.8).collect()}
    assert kept == {i if i < 1 << 63 else None for i in least.values()}
    assert len(kept) < simhash.one_of_each(docs).count()
    assert simhash.one_of_each(docs.limit(0), share=0.8).count() == 0


def plain_pairs(prints):
    return {(a, b) for b in range(len(prints)) for a in np.flatnonzero(np.bitwise_count(prints[:b] ^ prints[b]) <= 2).tolist()}


@pytest.mark.parametrize("centres", [1, 4, 900])
def test_vantage_point_trees_lose_no_pair(centres, monkeypatch):
    rng = np.random.default_rng(centres)
    base = rng.integers(0, 1 << 63, centres, dtype=np.uint64)
    prints = base[rng.integers(0, centres, 2600)]
    for _ in range(3):
        prints = np.where(rng.random(len(prints)) < 0.6, prints ^ (np.uint64(1) << rng.integers(0, 64, len(prints)).astype(np.uint64)), prints)
    prints = np.unique(prints)
    expected = plain_pairs(prints)

    def named(pieces):
        return {(min(i, j), max(i, j)) for a, b in pieces for i, j in zip(np.searchsorted(prints, a).tolist(), np.searchsorted(prints, b).tolist())}

    assert named(simhash.pairs(prints)) == expected
    tree = simhash.grow(prints[::3], 60)
    assert named(p for _, held in simhash.deal(tree, prints) for p in simhash.pairs(held)) == expected
    u, v = simhash.stars(prints)
    seen = {frozenset((int(a), int(b))) for a, b in zip(u, v)}
    assert len(seen) == len(u) and (len(u) > 0) == bool(expected)


def test_dense_balls_are_searched_by_their_differences():
    centre = np.uint64(0x0123456789ABCDEF)
    rng = np.random.default_rng(8)
    prints = np.full(9000, centre)
    for _ in range(3):
        prints = prints ^ (np.uint64(1) << rng.integers(0, 64, len(prints)).astype(np.uint64))
    prints = np.unique(prints)
    assert len(prints) > 4096
    u, v = simhash.stars(prints)
    assert len(u) == len(prints) - 1 and len(set(v.tolist())) == 1


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 120)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 120)} == {100} and got[201] == 200
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# Lines.


def plain_lines(rows):
    lines = sorted(
        ((i if i is not None else 1 << 63, xx), n, tuple(WORD.findall(x))) for xx, (i, t) in enumerate(rows) for n, x in enumerate((t or "").split("\n")) if len(WORD.findall(x)) >= 5
    )
    first = {}
    for (i, xx), n, w in lines:
        first.setdefault(w, (i, xx, n))

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    lost = {w for w, at in first.items() if any(o < at and near(w, v) for v, o in first.items())}
    gone = {}
    for (i, xx), n, w in lines:
        if w in lost or first[w] != (i, xx, n):
            gone.setdefault(xx, set()).add(n)
    return [(None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(xx, ())), len(gone.get(xx, ()))) for xx, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("row_words", [line_dedup.ROW_WORDS, 10])
def test_near_lines_against_brute_force(spark, monkeypatch, row_words):
    monkeypatch.setattr(line_dedup, "ROW_WORDS", row_words)
    rng = random.Random(6)
    rows = [(i, "\n".join(" ".join(rng.choice("abc") for _ in range(rng.choice([3, 5, 6, 7, 8, 9, 15, 16, 17]))) for _ in range(6))) for i in range(40)]
    long = [f"w{k}" for k in range(60)]
    rows += [(200 + k, " ".join(long[:k] + ["zz"] + long[k + 1 :]) + "\n \ta  b c d e f\r") for k in range(5)]
    rows += [(100, None), (101, ""), (102, "\n\n a b c d e f"), (None, "a b c a b c a\nq r s t u v")]
    docs = spark.createDataFrame([(i, t, -1, -2, None) for i, t in rows], "doc_id long, text string, no int, k_id int, gone string")
    got = {(r.doc_id, r.text): r._n_removed for r in line_dedup.line_dedup(docs).collect()}
    assert got == {(i, text): n for (i, _), (text, n) in zip(rows, plain_lines(rows))}


def test_lines_whose_keys_collide_lose_no_rival(spark, monkeypatch):
    plain = line_dedup._variants
    monkeypatch.setattr(line_dedup, "_variants", lambda texts: plain(texts).withColumn("key", F.pmod("key", F.lit(7))))
    rng = random.Random(16)
    rows = [(i, "\n".join(" ".join(rng.choice("abcd") for _ in range(rng.choice([5, 6, 7]))) for _ in range(5))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text): r._n_removed for r in line_dedup.line_dedup(docs).collect()}
    assert got == {(i, text): n for (i, _), (text, n) in zip(rows, plain_lines(rows))}


def test_equal_rows_and_empty_tables(spark):
    row = (1, "one two three four five\nsix seven eight nine ten")
    docs = spark.createDataFrame([row, row, (2, row[1])], "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r._n_removed) for r in line_dedup.line_dedup(docs).collect())
    assert got == [(1, row[1], 0), (1, row[1], 0), (2, "", 2)]
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_short_lines_go_if_equal(spark):
    rows = [(1, "All rights reserved.\n\n一二三\na b c d\none two three four five"), (2, "all rights reserved.\n \n一二三\na b c x\none two three four"), (3, " All  rights reserved.\nOne\nOne")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r._n_removed) for r in line_dedup.line_dedup(docs, short=True).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("all rights reserved.\n \na b c x\none two three four", 1), 3: ("One", 2)}
    assert [r._n_removed for r in line_dedup.line_dedup(docs).collect()] == [0, 0, 0]


def test_shuffled_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    rows = [(1, "a b c d e f g"), (2, "a b c d e x g"), (3, "q b c d e x g z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r._n_removed) for r in line_dedup.line_dedup(docs).collect()) == [(1, 0), (2, 1), (3, 0)]


def test_row_keys_separate_rows():
    data, offsets = tk.utf8(pa.array(["a", "b", "a", "a", "b"]))
    ids = np.array([1, 1, 1, substring_dedup.LAST_ID, substring_dedup.LAST_ID])
    pairs = list(zip(*(x.tolist() for x in substring_dedup.row_keys(ids, data, offsets))))
    assert pairs[0] == pairs[2] and len(set(pairs)) == 4
    assert substring_dedup.ranks(*substring_dedup.row_keys(ids, data, offsets)).tolist() == ids.tolist()


def test_rows_without_ids_are_told_apart_where_text_keys_collide(spark, monkeypatch):
    """All text keys of a worker collide; what is left to tell rows apart is the id, or the other half of the hash."""
    plain = substring_dedup.row_keys

    def colliding(ids, data, offsets):
        names, keys = plain(ids, data, offsets)
        return names, keys & substring_dedup.NO_ID

    monkeypatch.setattr(substring_dedup, "row_keys", colliding)
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (None, " ".join(words[:30] + ["x"] * 20)), (None, " ".join(["y"] * 9 + words[20:50])), (None, "z " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    packs = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    made = pa.Table.from_batches(substring_dedup._packs(iter([packs]), np.zeros(0, np.uint64), 1))
    assert len(set(zip(made["k_id"].drop_null().to_pylist(), made["k_text"].drop_null().to_pylist()))) >= 2
    monkeypatch.undo()
    got = {r.kept: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == {rows[0][1]: (60, 0), " ".join(["x"] * 20): (50, 30), " ".join(["y"] * 9): (39, 30), ("z " * 40).strip(): (40, 0)}


def test_many_equal_rows_without_ids(spark):
    """A hundred thousand rows with one text: its ranges are held once, not once a row."""
    words = [f"w{k}" for k in range(40)]
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(" ".join(words[:20] + ["end"])).alias("text"))
    docs = rows.unionByName(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"))
    out = substring_dedup.substring_dedup(docs).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert {tuple(r) for r in out} == {(1, 40, 0, 1), (None, 21, 20, 100_000)}



def test_long_lines_have_the_variants_of_short_ones(spark, monkeypatch):
    """Made in blocks within the row, and by a window over words: the same keys."""
    line = lambda n: " ".join(f"w{(k * k) % 97}" for k in range(n))
    texts = spark.createDataFrame([(1, 1, k, line(n), n) for k, n in enumerate((5, 63, 64, 65, 128, 130, 1000, 5000))], "k_id long, k_text long, no int, line string, n int")
    by_row = sorted(map(tuple, line_dedup._variants(texts).collect()))
    monkeypatch.setattr(line_dedup, "ROW_WORDS", 4)
    assert by_row == sorted(map(tuple, line_dedup._variants(texts).collect()))


def test_columns_named_like_those_of_the_line_dedup_stay(spark):
    import corpus_pipeline

    text = "one two three four five six\nanother line of some more words"
    docs = spark.createDataFrame([(1, text, 7, "a", 3, "b"), (2, text, 8, "c", 4, "d")], "doc_id long, text string, _n_lines int, gone string, k_id int, lines string")
    out = sorted(map(tuple, line_dedup.line_dedup(docs).collect()))
    assert out == [(1, text, 7, "a", 3, "b", 2, 0), (2, "", 8, "c", 4, "d", 2, 2)]
    staged = corpus_pipeline.lines(spark, docs, "")
    assert staged.columns == docs.columns and sorted(map(tuple, staged.collect())) == [r[:6] for r in out]
