import pytest

from textloom.llm.catalog import ORACLE, QUERIES

from ..sqlcheck import FOLDER, connection, differences

#: Columns that the queries of found cases must have.
FOUND = {
    1: ["term", "mark"], 2: ["doc_id", "seg_no", "lang"], 3: ["page_id", "src_field", "block_key"], 4: ["id", "label"], 5: ["doc_id", "kind"],
    6: ["site", "line_key"], 7: ["term_a", "term_b"], 8: ["doc_id"], 9: ["source"], 10: ["doc_id_a", "doc_id_b"],
}


@pytest.fixture(scope="module")
def database():
    return connection()


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, database, name):
    assert differences(spark, QUERIES[name], ORACLE[name], database) == ([], [])


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
@pytest.mark.parametrize("number", sorted(FOUND))
def test_found_columns(spark, number):
    df = QUERIES[f"p{number}_found"](spark, str(FOLDER))
    assert df.columns == FOUND[number]
    rows = df.collect()
    assert len(rows) == len(set(rows))
    if number == 2:
        assert dict(df.dtypes)["seg_no"] == "int"


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    QUERIES[name](spark, str(FOLDER)).write.format("noop").mode("overwrite").save()
