from __future__ import annotations

import duckdb
import pytest

from tessella.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": [("source_table", "string"), ("ordinal", "bigint"), ("field", "string")],
    "p2_found": [("prompt_id", "bigint"), ("embedding_column", "string"), ("persona", "string"), ("rank_no", "bigint")],
    "p3_found": [("source_table", "string"), ("ordinal", "bigint"), ("defect", "string")],
    "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p7_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p8_found": [("doc_id", "bigint"), ("subject", "string")],
}


@pytest.fixture(scope="module")
def rows(spark):
    held: dict = {}

    def get(name):
        if name not in held:
            df = QUERIES[name](spark, SF)
            held[name] = df.dtypes, [tuple(r) for r in df.collect()]
        return held[name]

    return get


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_with_its_columns_and_without_repeats(rows, name):
    kinds, got = rows(name)
    assert got and kinds == COLUMNS.get(name, kinds)
    if name.endswith("_found"):
        assert len(got) == len(set(got))


def test_truncated_lines_are_those_of_p1(rows):
    one = {(s, o) for s, o, _ in rows("p1_found")[1]}
    three = rows("p3_found")[1]
    assert {(s, o) for s, o, d in three if d == "truncated"} == one
    assert len({(s, o) for s, o, _ in three}) == len(three)


def test_p2_against_sql(rows):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embedding_variance AS SELECT * FROM '{SF}/embedding_variance.parquet'")
    assert sorted(rows("p2_found")[1], key=repr) == sorted(c.execute(SQL["p2_found"]).fetchall(), key=repr)
