"""The registered queries against their SQL on the smallest tables, and the stream of changes."""

import os
from pathlib import Path

import pytest

from syntaxframe import registry
from syntaxframe.language import language_for
from syntaxframe.streaming.incremental import changed_versions

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    names = sorted(df.columns)
    got = sorted(str(tuple(r[n] for n in names)) for r in df.collect())
    result = duck.execute(registry.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    assert got == sorted(str(tuple(row[columns.index(n)] for n in names)) for row in result.fetchall())


def test_only_changed_versions_are_parsed(spark, tmp_path):
    source, schema = tmp_path / "in", "doc_id long, text string, ts long"
    versions = [(1, '{"k": 1}', 1), (1, '{"k": 1}', 2), (1, '{"k": 2}', 3), (2, '{"k": 5}', 1)]
    spark.createDataFrame(versions, schema).coalesce(1).write.parquet(str(source))
    stream = changed_versions(spark.readStream.schema(schema).parquet(str(source)), ts="ts")
    rows = language_for("json").extractor(registry.KeyK).extract(stream)
    query = rows.writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.doc_id, r.k) for r in spark.table("changes").collect()) == [(1, 1), (1, 2), (2, 5)]
