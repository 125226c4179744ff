"""Every query with SQL gives what the SQL gives, on the smallest tables."""

import math
import re
from pathlib import Path

import duckdb
import pytest

from lectern.plans import catalogue

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    relation = duck.sql(catalogue.SQL[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in relation.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    found = catalogue.QUERIES[name](spark, str(FOLDER))
    assert found.count() > 0 or name == "j9_near_exact"  # no near copies among so few documents


def test_sentences_of_all_chunks_equal_brute_force(spark, duck):
    texts = duck.sql("SELECT DISTINCT document_id, chunk_id, text FROM doc_chunks WHERE text IS NOT NULL").fetchall()
    assert any("\r" in t or re.search(r"[.!?]\s*\n", t) for _, _, t in texts)
    want = {(d, c, len(re.split(r"(?<=[.!?])\s+|\n+", t))) for d, c, t in texts}
    got = [(r.document_id, r.chunk_id, r.sentences) for r in catalogue.QUERIES["t4_sentences_all"](spark, str(FOLDER)).collect()]
    assert set(got) == want and len(got) == len(want)
