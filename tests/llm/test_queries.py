"""The registered queries: against their SQL on the smallest tables, and their result columns."""

from pathlib import Path

import pytest

from syntaxframe.llm import queries

DATA = Path("/root/testdata/sf0.001")
COLUMNS = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op4_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op5_url_filters": "page_id host path rule verdict",
    "op6_simhash": "doc_id fingerprint component_id",
    "op7_mixing": "doc_id size source_size target taken",
    "op9_token_counts": "doc_id n_tokens",
    "op10_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op11_token_binary": "doc_id start n_tokens ids_crc32",
    "op12_centroid_clustering": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    "op13_ranked_search": "item_id rank doc_id score",
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables here")
    df = queries.queries()[name](spark, str(DATA))
    assert set(COLUMNS.get(name, "").split()) <= set(df.columns)
    rows, names = df.collect(), sorted(df.columns)
    table = {"op4_warc": "pages", "op5_url_filters": "pages", "op12_centroid_clustering": "embeddings"}.get(name, "documents")
    con = duckdb.connect()
    # A search has a row for each place of each item, all others one for each row of their table.
    assert name == "op13_ranked_search" or len(rows) == con.execute(f"SELECT count(*) FROM '{DATA}/{table}.parquet'").fetchall()[0][0]
    if name not in queries.oracle_sql():
        return
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    result = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    assert sorted(str(tuple(r[n] for n in names)) for r in rows) == sorted(str(tuple(row[columns.index(n)] for n in names)) for row in result.fetchall())
