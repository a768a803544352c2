from __future__ import annotations

import os

import duckdb
import pytest

from seqweave.llm import queries

from ..test_entry import rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

COLUMNS = {
    "op1_": ["doc_id", "held_out", "score", "predicted"],
    "op2_": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op3_": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op4_": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op7_": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op8_": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op11_": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op12_": ["page_id", "host", "path", "rule", "verdict"],
    "op13_": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "op9_": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS.get(name[: name.index("_") + 1], ["doc_id"])) <= set(got.columns)
    data = got.collect()
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for table in ("documents", "benchmark", "conversations", "pages"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        want = con.execute(queries.ORACLE_SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert rows(got.columns, map(tuple, data)) == rows(columns, want.fetchall())
    elif "secret" not in name:
        table, key = ("pages", "page_id") if "page_id" in got.columns else ("documents", "doc_id")
        whole = spark.read.parquet(f"{SF}/{table}.parquet").count()
        assert len(data) == whole == len({r[key] for r in data})
