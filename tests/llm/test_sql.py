"""The operators' queries against their SQL, on tables with nulls, empty texts, copies and repeats inside a text."""

import duckdb
import pytest

from cairn.llm.queries import ORACLE_SQL, QUERIES

RUN = " ".join(f"word{i % 37}é{i}" for i in range(120))
TEXTS = [RUN, None, "", RUN, "one two", "x" * 450, "x" * 199, "x" * 200, f"head {RUN[:700]}\ntail", f"{RUN} {RUN}", " \t\n", "a\x1cb " * 90, "é" * 150 + "z" + "é" * 150, f"{RUN[:300]}|{RUN[400:900]}"]


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_agrees_with_sql(spark, tmp_path, name):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, None, t) for i, t in enumerate(TEXTS)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(tuple, got.select(*columns).collect()), key=repr)
    assert rows == sorted(want.select(*columns).fetchall(), key=repr)
    assert len(rows) == len(TEXTS)
