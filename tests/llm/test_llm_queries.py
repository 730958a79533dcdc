import os

import pytest

from spectraloom.llm import queries as q


def test_p2_against_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"create view gold_spectra as select * from '{sf_dir}/gold_spectra.parquet'")
    assert sorted(map(tuple, q.p2_found(spark, sf_dir).collect())) == sorted(con.sql(q.SQL["p2_found"]).fetchall())


def test_found_columns(spark, sf_dir):
    want = {"p2_found": "gold_id bigint, group_id string", "p3_found": "row_id_a bigint, row_id_b bigint", "p5_found": "row_id bigint, field string, ref_id int", "p6_ids": "doc_id bigint, ids array<int>"}
    for name, columns in want.items():
        if name == "p6_ids" and not os.path.exists("/opt/tokenizers/byte_bpe_50k.json"):
            continue
        assert ", ".join(f"{c} {t}" for c, t in q.QUERIES[name](spark, sf_dir).dtypes) == columns
