"""Archives, URL verdicts, the mix and the pipeline."""

import base64
import gzip
import hashlib
import io
import json
import random
import zlib
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from syntaxframe.llm import decontaminate, line_dedup, mixing, quality_rules, simhash, url_filters, warc
from syntaxframe.llm.shared import shared_dir

# Archives.


def test_archived_pages_against_plain_digests(spark):
    rows = [(3, "http://a/", "same"), (1, None, "same"), (None, "http://b/", "same"), (2, "http://c/\r\nx", "ünïcode\r\n\r\nWARC/1.1"), (5, "u", None), (6, "u", ""), (7, "u", "x" * 300_000), (1, "u", "same")]
    pages = spark.createDataFrame([(i, u, h, "z") for i, u, h in rows], "page_id long, url string, html string, sha1 string")
    got = sorted((tuple(r)[:5] for r in warc.archived(pages).collect()), key=str)
    least = {}
    for i, _, h in rows:
        least[h or ""] = min(least.get(h or "", 1 << 63), 1 << 63 if i is None else i)
    expected = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = least[h or ""]
        revisit = (1 << 63 if i is None else i) > first
        expected.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(expected, key=str)
    assert warc.archived(pages.limit(0)).count() == 0


@pytest.mark.parametrize("piece", [1, 7, 100_000])
def test_normaliser_rewrites_every_record_as_a_member(piece):
    originals = [warc.record(i, f"http://x/{i}", b"p" * (i * 50), i - 1, i % 2 == 1) for i in range(9)]
    mono = gzip.compress(b"".join(originals[:6])) + gzip.compress(b"".join(originals[6:]))
    sink = io.BytesIO()
    index = list(warc.members(warc.inflated(mono[i : i + piece] for i in range(0, len(mono), piece)), sink))
    raw = sink.getvalue()
    assert [zlib.decompress(raw[o : o + n], 31) for _, o, n in index] == originals
    assert [h["warc-type"] for h, _, _ in index] == ["revisit" if i % 2 else "response" for i in range(9)]
    assert gzip.decompress(raw) == b"".join(originals)


def test_truncated_archives_are_refused():
    with pytest.raises(ValueError):
        list(warc.records(iter([warc.record(1, None, b"abc", None, False)[:-6]])))


@pytest.mark.parametrize("piece", [1, 100_000])
def test_streams_cut_between_records_are_refused(piece):
    engine = zlib.compressobj(5, zlib.DEFLATED, 31)
    packed = [engine.compress(warc.record(i, None, b"p" * 900, None, False)) + engine.flush(zlib.Z_FULL_FLUSH) for i in range(50)]
    whole, cut = b"".join(packed) + engine.flush(), b"".join(packed[:25])
    pieces = lambda raw: (raw[i : i + piece] for i in range(0, len(raw), piece))
    assert len(list(warc.records(warc.inflated(pieces(whole + b"\0" * 512))))) == 50
    for bad in (cut, whole[:-1], whole[:-8], whole + whole[:5]):
        with pytest.raises(ValueError):
            list(warc.records(warc.inflated(pieces(bad))))
    assert list(warc.inflated(pieces(b""))) == []


def test_normalise_files_from_binary_rows(spark, tmp_path):
    (tmp_path / "in.warc.gz").write_bytes(gzip.compress(warc.record(1, "http://x/", b"abc", None, False) * 2))
    index = warc.normalise_files(spark.read.format("binaryFile").load(f"file://{tmp_path}/in.warc.gz"), f"{shared_dir(spark)}/norm")
    rows = index.orderBy("offset").collect()
    assert [r.offset for r in rows] == [0, rows[0].length]
    sidecar = open(rows[0].archive.removeprefix("file://") + ".index.jsonl").read().splitlines()
    assert [json.loads(x)["offset"] for x in sidecar] == [r.offset for r in rows]


# URLs.


def plain_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    best = None
    for verdict, rule in url_filters.RULES:
        name, _, below = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + below) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?y#z", "http://example.org", "http://example.org/en/12", "http://xexample.org/es/", "https://b.com/fr/", "http://com/de/?q=/fr/", "x://h#/a", "http://É.com/de/a\nb", "http://a.org:80/x"]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, 1.0) for i, u in enumerate(URLS)], "page_id long, url string, length double")
    got = {r.page_id: r for r in url_filters.url_verdicts(pages).collect()}
    for i, u in enumerate(URLS):
        host, path, best = plain_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[1])
        assert got[i].verdict == (best[0] if best else got[i].verdict) and got[i].verdict in ("allow", "block")
    assert url_filters.url_verdicts(pages.limit(0)).count() == 0


def test_trees_on_held_out_urls(spark):
    rng = random.Random(9)

    def url(bad):
        if bad:
            return f"http://x{rng.randrange(10**9)}.biz/{rng.randrange(10**6)}/{rng.randrange(10**6)}?a={rng.randrange(99)}&b=1&c=2"
        return f"http://site{rng.choice('abc')}.net/{rng.choice(['news', 'about', 'blog'])}/page"

    rows = [(i, url(i % 3 == 0), "block" if i % 3 == 0 else "allow") for i in range(900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    named = pages.withColumns({"host": url_filters.host_of(F.col("url")), "path": url_filters.path_of(F.col("url"))})
    data = url_filters.lexical(named)
    trees, suffixes = url_filters.fitted(data.where("page_id < 600"))
    held = data.where("page_id >= 600").withColumns(suffixes).select((trees.score() > 0).alias("says"), (F.col("verdict") == "block").alias("is"))
    rows = held.collect()
    assert sum(r.says == r["is"] for r in rows) / len(rows) > 0.95
    assert urlparse("http://a/b").path == "/b"


def test_rare_suffixes_have_statistics_and_may_be_joined(spark, monkeypatch):
    rows = [(i, f"http://s{i % 400}.t{i % 200}/p", "block" if i % 200 % 2 else "allow") for i in range(1600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    data = url_filters.lexical(pages.withColumns({"host": url_filters.host_of(F.col("url")), "path": url_filters.path_of(F.col("url"))}))
    counts = {part: url_filters.part_counts(data, part) for part in url_filters.PARTS}
    assert {r.suffix.split("/")[0]: (r.suffix_blocked, r.suffix_labelled) for r in counts["suffix"].collect()} == {f"t{k}": (8 * (k % 2), 8) for k in range(200)}
    trees, _, total = url_filters.trained(data, counts, 400)
    assert total == 1600 and trees.trees
    mixed = spark.createDataFrame([(i, f"http://{'example.org' if i % 3 else 'a.com'}/{'es' if i % 2 else 'de'}/{i}") for i in range(300)] + [(None, None)], "page_id long, url string")
    plain = sorted(map(str, url_filters.url_verdicts(mixed).collect()))
    monkeypatch.setattr(url_filters, "BROADCAST_SUFFIXES", 0)
    assert sorted(map(str, url_filters.url_verdicts(mixed).collect())) == plain


def test_trees_agree_with_rules_on_held_out_pages(spark):
    folder = Path("/root/testdata/sf0.1")
    if not folder.exists():
        pytest.skip("no test tables here")
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    named = pages.withColumns({"host": url_filters.host_of(F.col("url")), "path": url_filters.path_of(F.col("url"))})
    rule, verdict = url_filters.rule_of(F.col("host"), F.col("path"))
    data = url_filters.lexical(named.withColumn("verdict", verdict)).where("verdict is not null")
    trees, suffixes = url_filters.fitted(data.where("page_id % 2 = 0"))
    held = data.where("page_id % 2 = 1").withColumns(suffixes).select((trees.score() > 0).alias("says"), (F.col("verdict") == "block").alias("is")).collect()
    right = sum(r.says == r["is"] for r in held) / len(held)
    most = max(sum(r["is"] for r in held), sum(not r["is"] for r in held)) / len(held)
    print(right, most, len(held))
    # Block rules on leading digits cannot be told from these features.
    assert right > 0.85 and right > most + 0.05


# The mix.


def plain_targets(sizes):
    total, capped, out = sum(s for s, _ in sizes), set(), {}
    while True:
        left = total - sum(3 * sizes[i][0] for i in capped)
        weight = sum(w for i, (_, w) in enumerate(sizes) if i not in capped)
        out = {i: 3 * s if i in capped else left * w / weight for i, (s, w) in enumerate(sizes)}
        over = {i for i, (s, _) in enumerate(sizes) if i not in capped and out[i] > 3 * s * (1 + 1e-12)}
        if not over:
            return out
        capped |= over


def test_targets_by_water_filling(spark):
    sizes = [5, 400, 1000, 7, 0, 90, 2000, 10, 3]
    rows = [(f"s{i}", 1, s) for i, s in enumerate(sizes[:-1])] + [(None, 1, sizes[-1])]
    got = mixing.source_targets(spark.createDataFrame(rows, "source string, n_docs long, source_size long")).orderBy("rank").collect()
    assert [r.source for r in got] == [*(f"s{i}" for i in range(8)), None]
    expected = plain_targets([(s, (1, 2, 3)[i % 3]) for i, s in enumerate(sizes)])
    assert [r.target for r in got] == pytest.approx([expected[i] for i in range(len(sizes))])


@pytest.mark.parametrize("n", [1, 2, 3, 97, 1000])
def test_permutations_are_exact(spark, n):
    got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5))).collect()]
    assert sorted(got) == list(range(n)) and (n < 50 or got != list(range(n)))


def mix_docs(spark):
    rng = random.Random(10)
    rows = [(i, rng.choice(["a", "b", "b", "b", "é", None]), " ".join(["w"] * rng.choice([0, 5, 50, 300]))) for i in range(300)]
    rows += [(1, "a", "twice the same id"), (None, "a", None), (None, None, "x y")]
    return spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, source string, text string, size int")


def test_mix_meets_its_targets(spark):
    docs = mix_docs(spark)
    rows = mixing.mixture(docs).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    by = {}
    for r in rows:
        held = by.setdefault(r.source_size, [0, 0, r.target])
        held[0] += r["size"]
        held[1] += r.taken
    for size, (whole, taken, target) in by.items():
        assert whole == size and abs(taken - target) <= max(2 * mixing.BLOCK, 0.02 * target)
    again = mixing.mixture(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mixing.mixture(docs.limit(0)).count() == 0


def test_mixed_texts_are_what_the_counts_say(spark):
    docs = mix_docs(spark)
    texts = mixing.mixed_texts(docs)
    words = texts.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == mixing.mixture(docs).agg(F.sum("taken")).first()[0]
    counts = texts.select("shard", "slot").distinct().groupBy("shard").count().collect()
    assert all(r["count"] <= mixing.SHARD_SLOTS for r in counts)


@pytest.mark.parametrize("most", [mixing.LOOKUP_SOURCES, 2])
def test_shards_draw_multinomial_counts(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "LOOKUP_SOURCES", most)
    wants = [40_000, 0, 1, 7_999, 32_000]
    plan = spark.createDataFrame([(i, sum(wants[:i]), w) for i, w in enumerate(wants)], "rank long, start long, want long")
    total, shard = sum(wants), 500
    rows = mixing.shard_counts(plan, total, shard).collect()
    assert sorted(x for r in rows for x in r.slots) == list(range(total)) and all(x // shard == r.shard for r in rows for x in r.slots)
    n_shards = total // shard
    by = {(r.shard, r["rank"]): len(r.slots) for r in rows}
    # Pearson's statistic over shards and the three large sources (2 free counts a shard): its mean is 2 a shard, its variance 4.
    large = {0: 0.5, 3: 7_999 / total, 4: 0.4}
    chi = sum((by.get((s, r), 0) - shard * p) ** 2 / (shard * p) for s in range(n_shards) for r, p in large.items())
    assert abs(chi - 2 * n_shards) < 4 * (4 * n_shards) ** 0.5


@pytest.mark.parametrize("most", [mixing.LOOKUP_SOURCES, 2])
def test_draws_use_each_block_once_a_pass(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "LOOKUP_SOURCES", most)
    sizes = [100_000, 3, 64, 20_000, 0, 900]
    sources = mixing.source_targets(spark.createDataFrame([(f"s{i}", 1, n) for i, n in enumerate(sizes)], "source string, n_docs long, source_size long"))
    want = {r["rank"]: round(r.target * -(-r.source_size // mixing.BLOCK) / r.source_size) for r in sources.collect() if r.source_size}
    rows = mixing.slots_of(sources, shard_slots=100).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and all(r.slot // 100 == r.shard for r in rows)
    assert len({(r["rank"], r.epoch, r.block) for r in rows}) == len(rows)
    got = {}
    for r in rows:
        got[r["rank"]] = got.get(r["rank"], 0) + 1
        assert r.epoch < mixing.MAX_EPOCHS and r.block < -(-sizes[r["rank"]] // mixing.BLOCK)
    assert got == want


def test_the_mix_counts_draws_of_shards(spark):
    sources = mixing.source_targets(spark.createDataFrame([("a", 1, 5000), ("b", 1, 900)], "source string, n_docs long, source_size long"))
    plan = mixing.slots_of(sources).groupBy("rank", "block").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "slots" in plan and "shard" in plan


# The pipeline.


def test_pipeline_stage_by_stage(spark, tmp_path):
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(n))
    shared, passage, base = prose(12), prose(20), prose(90)
    rows = [(1, base), (2, base.replace(base.split()[5], "other", 1)), (3, prose(80) + "\n" + shared), (4, prose(80) + "\n" + shared), (5, "spam " * 200), (6, prose(60) + " " + passage), (7, prose(70)), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s" if i % 2 else "t", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    folder = f"file://{tmp_path}"
    docs.write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    kept = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder).cache()
        assert now.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in now.collect()}
    assert sorted(kept["quality rules"]) == [1, 2, 3, 4, 6, 7]
    assert kept["line dedup"][3].endswith(shared) and shared not in kept["line dedup"][4]
    assert sorted(kept["benchmark decontamination"]) == [i for i in sorted(kept["simhash near-dedup"]) if i != 6]
    whole = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in whole} == set(kept["benchmark decontamination"])
    # The same by the operators themselves.
    plain = line_dedup.line_dedup(quality_rules.quality_filter(docs)).drop("_n_lines", "_n_removed")
    plain = decontaminate.decontaminated(simhash.one_of_each(plain), bench)
    assert sorted(map(str, mixing.mixture(plain).collect())) == sorted(map(str, whole))


def test_pipeline_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    result = con.execute(corpus_pipeline.ORACLE_SQL)
    columns = [c[0] for c in result.description]
    df = corpus_pipeline.run(spark, str(folder))
    assert sorted(df.columns) == sorted(columns)
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(map(str, result.fetchall()))
