import pytest
from oracle import check, duck, sql_rows

from keyloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, sf, name):
    check(spark, QUERIES[name], ORACLE[name], sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_keeps_every_row(name):
    con = duck("/root/testdata/sf0.001")
    table = {"op1": "pages", "op2": "embeddings"}.get(name.split("_")[0], "documents")
    assert len(sql_rows(con, ORACLE[name])[1]) == con.execute(f"SELECT count(*) FROM {table}").fetchall()[0][0]
