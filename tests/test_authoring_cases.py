"""The cases of authoring_cases.py against their SQL."""

import pytest

from authoring_cases import CASES, SQL


@pytest.mark.parametrize("name", sorted(CASES))
def test_case_equals_its_sql(spark, name):
    con = pytest.importorskip("duckdb").connect()
    df = CASES[name](spark, "/nowhere")
    names = sorted(df.columns)
    result = con.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    assert sorted(str(tuple(r[n] for n in names)) for r in df.collect()) == sorted(str(tuple(row[columns.index(n)] for n in names)) for row in result.fetchall())
