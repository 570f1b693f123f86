"""Every query of the subpackage on the smallest tables: it runs, has the stated columns, and no repeated rows."""

import pytest

from scriptorium.llm.queries import QUERIES

COLUMNS = {
    "p1_found": [("translation_id", "bigint"), ("src_start", "int"), ("tgt_start", "int")],
    "p2_found": [("side", "string"), ("row_id", "bigint"), ("start_pos", "int"), ("end_pos", "int")],
    "p3_found": [("name_a", "string"), ("name_b", "string")],
    "p4_found": [("pair_kind", "string"), ("row_id", "bigint"), ("defect", "string")],
    "p5_found": [("side", "string"), ("id_a", "bigint"), ("id_b", "bigint")],
    "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p8_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, smallest, name):
    df = QUERIES[name](spark, smallest)
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
    rows = df.collect()
    assert rows or name == "p5_found"
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
