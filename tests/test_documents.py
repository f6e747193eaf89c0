"""The data source of documents."""

import zipfile

import pytest

from syntaxframe.language import language_for
from syntaxframe.sources import documents


@pytest.fixture
def folder(tmp_path):
    for k in range(40):
        (tmp_path / f"d{k % 4}").mkdir(exist_ok=True)
        (tmp_path / f"d{k % 4}" / f"t{k:02d}.{'json' if k % 2 else 'txt'}").write_text(f'{{"k": {k}}}' if k % 2 else f"é {k}\r\n", encoding="utf-8", newline="")
    with zipfile.ZipFile(tmp_path / "all.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(60):
            z.writestr(f"in/m{k:02d}.json", f'{{"k": {1000 + k}}}' + " " * 5000)
    (tmp_path / "_hidden").write_text("x")
    (tmp_path / ".dot").write_text("x")
    return tmp_path


def test_files_and_members_are_documents(spark, folder):
    documents.register(spark)
    df = spark.read.format("documents").load(str(folder))
    rows = {r.doc_id: r for r in df.collect()}
    assert len(rows) == 100
    one, other = rows[f"{folder}/d0/t00.txt"], rows[f"{folder}/all.zip!in/m07.json"]
    assert (one.text, one.kind, one.member, one.size) == ("é 0\r\n", "txt", None, 6)
    assert (other.text.strip(), other.kind, other.member) == ('{"k": 1007}', "json", "in/m07.json")
    from syntaxframe.registry import KeyK

    got = language_for("json").extractor(KeyK).extract(df.where("kind = 'json'").select("doc_id", "text"))
    assert sorted(r.k for r in got.collect()) == [k for k in range(40) if k % 2] + list(range(1000, 1060))


def test_small_ones_are_packed_and_archives_are_split(spark, folder):
    documents.register(spark)
    read = spark.read.format("documents")
    assert read.load(str(folder)).rdd.getNumPartitions() == 1
    assert read.option("partitionBytes", (3 << 20) + 100).load(str(folder / "d0")).rdd.getNumPartitions() == 4
    parts = read.option("partitionBytes", (1 << 20) + 60_000).load(str(folder / "all.zip")).rdd.glom().map(len).collect()
    assert len(parts) > 3 and sum(parts) == 60
    assert documents.packed([], 10) == []


def test_conditions_on_the_listing_are_taken(spark, folder):
    documents.register(spark)
    for source in ("d1/t01.json", "d3/t03.json"):  # unreadable as text, and never read
        (folder / source).write_bytes(b"\xff\xfe")
    df = spark.read.format("documents").load(str(folder))
    some = df.where("kind = 'txt' and path like '%/d2/%' and text like '%é%'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo" in plan or "kind" in plan
    assert sorted(r.text for r in some.collect()) == sorted(f"é {k}\r\n" for k in range(40) if k % 4 == 2)
    reader = documents.DocumentReader(documents._Options(documents.Documents({"path": str(folder)})), ["path"])
    kept = list(reader.pushFilters([documents.EqualTo(("kind",), "txt"), documents.StringContains(("text",), "é"), documents.In(("member",), ("a",))]))
    assert [type(f).__name__ for f in kept] == ["StringContains"] and len(reader.tests) == 2 and reader.partitions() == []
    assert df.where("kind = 'txt'").select("size").groupBy().sum("size").first()[0] == sum(len(f"é {k}\r\n".encode()) for k in range(0, 40, 2))


def test_other_encodings_and_empty_or_missing_folders(spark, tmp_path):
    documents.register(spark)
    (tmp_path / "a").mkdir()
    read = spark.read.format("documents")
    assert read.load(str(tmp_path / "a")).collect() == []
    (tmp_path / "a" / "x").write_bytes("é".encode("latin-1"))
    assert [r.text for r in read.load(str(tmp_path / "a")).collect()] == ["�"]
    assert [(r.text, r.kind) for r in read.option("encoding", "latin-1").load(str(tmp_path / "a")).collect()] == [("é", "")]
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("documents").load(str(tmp_path / "nowhere")).collect()


def test_a_stream_reads_each_file_once(spark, tmp_path):
    import os

    documents.register(spark)
    (tmp_path / "in").mkdir()

    def put(name, at):
        path = tmp_path / "in" / name
        path.write_text(name)
        os.utime(path, (at, at))

    def run():
        stream = spark.readStream.format("documents").load(str(tmp_path / "in")).select("doc_id", "text")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start().awaitTermination()
        return sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put("a", 100), put("b", 100)
    assert run() == ["a", "b"]
    put("c", 100), put("d", 200)
    assert run() == ["a", "b", "c", "d"]
    assert run() == ["a", "b", "c", "d"]
