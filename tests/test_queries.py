import pytest
from compare import connection, difference

from lectern.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


#: Queries whose feature it is to return nothing.
EMPTY = {"fts_search_empty_scope"}


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), ORACLES[name], con) == ""
    some = lambda c: c.execute(f"SELECT count(*) FROM ({ORACLES[name]})").fetchone()[0] > 0
    assert some(con) or name in EMPTY or some(connection("/root/testdata/sf0.01"))


def test_snippets(spark):
    rows = QUERIES["fts_snippets"](spark, SF).collect()
    assert rows
    for r in rows:
        assert "⟦" in r["snippet"] and len(r["snippet"].strip("…").split(" ")) <= 14


def test_snippet_parts_beside_other_letters(spark, tmp_path):
    rows = [(1, "a thé édé der, thees x"), (2, None), (3, "de"), (4, "ländér thß ü de_ the-de")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    name = "str27_snippet_parts"
    assert difference(QUERIES[name](spark, str(tmp_path)), ORACLES[name], connection(str(tmp_path))) == ""
