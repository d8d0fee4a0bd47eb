"""Every registered query on the smallest tables: its columns and, where SQL can say it, its rows."""

import duckdb
import pytest

from tallyloom.llm import queries

COLUMNS = {
    1: "doc_id fingerprint component_id",
    2: "doc_id text",
    3: "doc_id start end component_id removed",
    4: "doc_id held_out score predicted",
    5: "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    6: "doc_id n_bytes n_removed n_spans kept_sha256",
    7: "query_id rank vec_id score",
    8: "doc_id n_tokens ids_sha256 decoded_sha256",
    9: "doc_id",
    10: "doc_id n_words n_hit n_items items_sha256 contaminated",
    11: "doc_id n_words n_base first_word last_word base_labels labels score",
    12: "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    13: "item_id rank doc_id score",
}
A_ROW_A_DOCUMENT = {1, 2, 4, 6, 8, 9, 10, 11, 12}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_contract(spark, sf, name):
    n = int(name[2:].split("_")[0])
    got = queries.QUERIES[name](spark, sf)
    assert set(COLUMNS[n].split()) <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    rows = got.collect()
    if n in A_ROW_A_DOCUMENT:
        ids = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
        assert sorted(r.doc_id for r in rows) == sorted(ids)
    if name in queries.ORACLES:
        c = duckdb.connect()
        for t in ("documents", "benchmark", "conversations", "embeddings"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = c.execute(queries.ORACLES[name])
        columns = [x[0] for x in want.description]
        assert sorted((tuple(r[x] for x in columns) for r in rows), key=str) == sorted(want.fetchall(), key=str)
