"""The registered queries on the smallest tables: equal to their SQL where they have one, and running where not."""

from pathlib import Path

import duckdb
import pytest

from lectern.llm.queries import QUERIES, SQL

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
FOUND = {
    "p1_found": {"paper_id", "span_start", "span_end"}, "p2_found": {"term", "mark"}, "p3_found": {"kind", "id_a", "id_b"}, "p4_found": {"document_id", "page_number", "line_no", "kind"},
    "p5_found": {"kind", "item_key"}, "p6_found": {"document_id", "page_number", "line_no"}, "p7_found": {"vec_id_a", "vec_id_b"}, "p8_found": {"doc_id"}, "p9_found": {"doc_id", "item_id"}, "p10_found": {"doc_id", "subject"},
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    relation = duck.sql(SQL[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in relation.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(FOUND))
def test_found_has_the_given_columns_and_distinct_rows(spark, name):
    df = QUERIES[name](spark, str(FOLDER))
    assert set(df.columns) == FOUND[name]
    assert df.count() == df.distinct().count()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - set(FOUND)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0  # five labels say nothing about subjects
