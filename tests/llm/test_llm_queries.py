"""The thin queries: columns, types and rows of the contracts, and SQL where there is some."""

import os
import zlib

import duckdb
import pytest

from tonelake.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")],
    "op2": [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")],
    "op3": [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")],
    "op5": [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")],
    "op6": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op7": [("conv_id", "bigint"), ("n_turns", "bigint"), ("turns_sha256", "string"), ("loss_chars", "bigint"), ("loss_sha256", "string"), ("formatted_chars", "bigint")],
    "op8": [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")],
    "op9": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op11": [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")],
    "op12": [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *[(c, "bigint") for c in ("a", "l", "r", "n", "score")]],
    "op13": [(c, "bigint") for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends_sha256", "string")],
}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    wanted = COLUMNS.get(name.split("_")[0])
    assert wanted is None or df.dtypes == wanted
    got = df.collect()
    assert got
    if "doc_id" in df.columns and not name.startswith("op4"):
        assert sorted(r.doc_id for r in got) == [r[0] for r in con.sql("SELECT doc_id FROM documents ORDER BY 1").fetchall()]
    if "held_out" in df.columns:
        n, k = (3, 1) if name.startswith("op6") else (4, 2)
        limit = 0.5 if n == 3 else 0.3
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == k) and 0 <= r.score <= 1 and r.predicted == int(r.score >= limit) for r in got)
    if name in queries.ORACLES:
        rel = con.sql(queries.ORACLES[name])
        order = [rel.columns.index(c) for c in df.columns]
        assert sorted(map(tuple, got)) == sorted(tuple(r[i] for i in order) for r in rel.fetchall())
