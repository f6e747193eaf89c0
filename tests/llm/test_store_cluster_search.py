"""Token store, centroid clustering and ranked search, against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from syntaxframe.llm import clustering, ranked_search, token_store

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
WORDS = public.path("word_bpe_49k.json")

ODD = [None, "", " \n\t ", "one", "It's HE'LL 2024, naïve Ünïcode ☃ ΣΑΣ ς", "x<|endoftext|>y  z", "é é a b c d\x1fe", "lang " * 3000, "q" * 5000, "İstanbul ﬁne 日本語 テキスト", "a\x00b"]


# Token store.


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(-(2**62), 2**62), max_size=400))
def test_slots_are_a_permutation(keys):
    hashes = [token_store.key_hash(k) for k in keys]
    h1, h2 = (np.array([h[i] for h in hashes], np.int64).view(np.uint64) for i in (0, 1))
    perfect = token_store.PerfectHash.of(h1, h2)
    assert sorted(perfect.slots(h1, h2).tolist()) == list(range(len(keys)))
    again, _ = token_store.PerfectHash.read(perfect.tobytes())
    assert again.slots(h1, h2).tolist() == perfect.slots(h1, h2).tolist()


def test_foreign_keys_are_known_by_their_fingerprints():
    keys = np.arange(20_000)
    h1, h2 = (np.array([token_store.key_hash(int(k))[i] for k in keys], np.int64).view(np.uint64) for i in (0, 1))
    raw = token_store.Bucket.tobytes(h1[:10_000], h2[:10_000], keys[:10_000], keys[:10_000] + 1, keys[:10_000] + 2)
    bucket = token_store.Bucket(raw)
    there, slot = bucket.find(h1, h2)
    assert there[:10_000].all() and not there[10_000:].any()
    assert (bucket.shard[slot] == keys[:10_000]).all() and (bucket.copies[slot] == keys[:10_000] + 2).all()


def expected_store(rows, end=1, path=WORDS):
    """{doc_id: [(start, n, crc)]} in the store's order, for rows whose ids are unique or equal rows."""
    engine, at, out = tokenizers.Tokenizer.from_file(path), 0, {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = engine.encode(text or "", add_special_tokens=False).ids + [end]
        out.setdefault(doc_id, []).append((at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def stored(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.start):
        out.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    return out


def test_store_holds_the_ids_of_whole_texts(spark):
    rows = [(k * 7 % 101, t) for k, t in enumerate(ODD)] + [(None, "no id"), (500, "same row"), (500, "same row")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, shard string, start int")
    assert stored(token_store.token_digests(docs, WORDS)) == expected_store(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abÉÀß'sT12.,!\u0130\u01c5\u0301Σσé \n\t<|>²\xa0\xad-", max_size=25), max_size=6))
def test_words_and_pieces_give_the_ids_of_whole_texts(encoder, texts):
    texts = [*texts, "it's<|EndOfText|>x", "a<|endoftext|>b C", "İ ŉ ǅ Σ"]
    got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encoded([t.encode() for t in texts])]
    assert got == [encoder._ids(t) for t in texts]


@pytest.fixture(scope="module")
def encoder():
    with open(WORDS, encoding="utf-8") as file:
        return token_store.Encoder(file.read())


def test_what_is_forgotten_is_learnt_again(encoder, monkeypatch):
    monkeypatch.setattr(token_store, "CACHE_BYTES", 2000)
    rng = random.Random(3)
    for _ in range(40):
        text = " ".join("".join(rng.choices("abcde.É", k=rng.randint(1, 5))) for _ in range(30))
        assert np.frombuffer(encoder.encoded([text.encode()])[0], encoder.kind).tolist() == encoder._ids(text)


def test_copies_of_an_id_run_on_over_shards(spark):
    rows = [(5, f"copy {k}") for k in range(60)] + [(k, "other") for k in range(5)] + [(None, "lost"), (None, "lost too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    store = token_store.TokenStore.write(docs, WORDS, 1, shard_bytes=1)
    found = store.read(docs.select("doc_id").distinct(), ids=True).collect()
    engine = tokenizers.Tokenizer.from_file(WORDS)
    assert sorted((str(r.doc_id), r.ids) for r in found) == sorted((str(i), engine.encode(t, add_special_tokens=False).ids + [1]) for i, t in rows)
    starts = sorted((r.start, r.n_tokens, r.doc_id) for r in found)
    assert [s for s, _, _ in starts] == np.cumsum([0, *(n for _, n, _ in starts)])[:-1].tolist()
    assert [i for _, _, i in starts] == [0, 1, 2, 3, 4] + [5] * 60 + [None] * 2
    # One key at a time, from a store that is opened anew.
    again = token_store.TokenStore.open(spark, store.folder)
    want = sorted(engine.encode(t, add_special_tokens=False).ids + [1] for i, t in rows if i == 5)
    assert sorted(x.tolist() for x in again.get(5)) == want and len(again.get(None)) == 2 and again.get(77) == []
    path = store.manifest().select("path").first()[0]
    inner = path.removeprefix("file://")
    with open(inner, "rb") as file:
        raw = file.read()
    with open(inner + ".cut", "wb") as file:
        file.write(raw[:-3])
    with pytest.raises(ValueError, match="cut off"):
        token_store.opened_shard(path + ".cut")


def test_a_tokenizer_without_word_borders_takes_whole_texts(spark):
    path = public.path("byte_bpe_50k.json")
    rows = list(enumerate(t for t in ODD if t is None or len(t) < 1000))
    with open(path, encoding="utf-8") as file:
        definition = file.read()
    assert not token_store.Encoder(definition).by_word
    with open(WORDS, encoding="utf-8") as file:
        assert token_store.Encoder(file.read()).by_word
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert stored(token_store.token_digests(docs, path, 7)) == expected_store(rows, 7, path)


def test_empty_store(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.token_digests(docs, WORDS).collect() == []


# Clustering.


def plain_clusters(rows, clusters=16, rounds=3, dims=64, scale=64):
    whole = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in whole)
    centroids = [v for _, v in named[:clusters]]
    for n in range(rounds + 1):
        chosen = [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids)) for _, v in whole]
        if n < rounds:
            for k in range(len(centroids)):
                mine = [v for (_, v), (_, c) in zip(whole, chosen) if c == k]
                if mine:
                    centroids[k] = [sum(x) // len(mine) for x in zip(*mine)]
    each = Counter()
    for d, c in chosen if whole else []:
        each[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), c, d, each[c], sum(each.values()), digest[c]) for (i, _), (d, c) in zip(whole, chosen if whole else []))


def clusters_of(df):
    return sorted((str(r.vec_id), *r[1:]) for r in df.collect())


def test_clusters_equal_a_plain_version(spark):
    rng = random.Random(5)
    vectors = [[rng.gauss(0, 0.4) for _ in range(64)] for _ in range(120)]
    wide = [[x * 3000 for x in v] for v in vectors[:6]]
    odd = [None, [], [1.0] * 63, [1.0] * 65, [None] + [0.5] * 63, [float("nan")] + [0.5] * 63, [float("inf")] + [0.5] * 63]
    rows = [(k, v) for k, v in enumerate(vectors + wide + odd + [vectors[3]] * 200)] + [(None, vectors[1]), (7, vectors[9]), (7, vectors[9])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, cluster int").repartition(5)
    assert clusters_of(clustering.clustered(df)) == plain_clusters(rows)


def test_ties_go_to_the_smaller_number_and_few_vectors_give_few_clusters(spark):
    rows = [(k, [float(k % 2)] * 4) for k in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert clusters_of(clustering.clustered(df, dims=4)) == plain_clusters(rows, dims=4)
    assert clusters_of(clustering.clustered(df, clusters=3, dims=4)) == plain_clusters(rows, clusters=3, dims=4)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert clustering.clustered(df).collect() == [] and clustering.clustered(df.limit(0)).collect() == []


def test_components_too_large_are_refused(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="after scaling"):
        clustering.clustered(df).collect()


# Ranked search.

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_search(docs, items, top=10):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    held = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for doc, bag, n in bags:
            m, score = 25 + (75 * n * n_docs) // n_terms, 0
            for term, times in Counter(TERM.findall((text or "").translate(LOWER))).items():
                if term in bag:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[term] + 1)))
                    score += times * w * ((10**9 * bag[term]) // (1000 * bag[term] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(str(item), k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def ranks_of(df):
    return sorted(((str(r.item_id), r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed, top, reach, block", [(1, 10, 7, 1 << 20), (2, 3, 1000, 1 << 20), (3, 10, 16, 60), (4, 1, 5, 1 << 20)])
def test_search_equals_a_plain_version(spark, seed, top, reach, block):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["The", "É", "ß1"]
    weights = [1 / (k + 1) for k in range(len(words))]
    text = lambda n: " ".join(rng.choices(words, weights, k=n)) + rng.choice(["", ".", "\n-"])
    docs = [(k, text(rng.randint(1, 40))) for k in range(150)] + [(k, None) for k in range(150, 155)] + [(200, ""), (None, "w3 w40"), (3, "w3 w40"), (201, "the THE w1")]
    docs += [(300 + k, "same words w7 w8 w9") for k in range(30)]
    items = [(k, text(rng.randint(1, 20))) for k in range(12)] + [(90, None), (91, "!?"), (92, "nowhere"), (1, "w7 w8 w8"), (None, "w5"), (93, "w7 " * 500)]
    df = spark.createDataFrame([(i, t, "x", 2) for i, t in docs], "doc_id long, text string, term string, row int").repartition(5)
    asked = spark.createDataFrame([(i, t, 4) for i, t in items], "item_id long, text string, rank int")
    assert ranks_of(ranked_search.ranked(df, asked, top=top, reach=reach, block_bytes=block)) == plain_search(docs, items, top)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.ranked(docs.limit(0), items).collect() == []
    assert ranked_search.ranked(docs, items.limit(0)).collect() == []
    assert ranked_search.ranked(docs.where("text is null"), items).collect() == []


def test_thresholds_leave_entries_out(spark):
    """The second phase is one: lists send less than they hold, and yet the rows are right."""
    docs = [(k, "common " * (1 + k % 3) + (f"rare{k % 200} " if k % 2 else "")) for k in range(2000)]
    items = ranked_search.Items([1], ["common rare1 rare1 rare1"])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    forward = ranked_search.written(ranked_search.forward_index(df, items.vocabulary), "t")
    n, total, held = ranked_search.corpus_counts(forward, len(items.vocabulary))
    weights = np.array([ranked_search.weight(n, h) for h in held.tolist()])
    lists = ranked_search.written(ranked_search.postings(forward, weights, n, total), "t")
    acting = items.acting(weights)
    heads = ranked_search.in_heads(lists, acting)
    scored = sorted((r.score for r in ranked_search.exact_scores(heads.select("item", "row"), forward, acting, weights, n, total).collect()), reverse=True)
    bounds = np.array([scored[9]])
    assert bounds[0] > 0
    assert ranked_search.candidates(lists, acting, bounds, len(weights)).count() < 100
