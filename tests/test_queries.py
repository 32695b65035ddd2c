import ast
import os
import pathlib

import duckdb
import pytest

from cairn import queries
from cairn.functions import fmt

DATA = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).parent.parent
CHECKED = ["proc_filter", "proc_defaults", "ets_multi_owner", "memory_total", "section_groups", "ingest_stats", "addr_lookup", "depth_limit", "dropped_lines", "incomplete_flag", "label_ambiguity"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", CHECKED)
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for f in pathlib.Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = queries.QUERIES[name](spark, DATA)
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.select(*columns).fetchall()))


def test_rows_of_many_lines(spark):
    rows = spark.createDataFrame([(1, 70_000), (2, 3), (3, 140_000)], "k long, n long")
    F = fmt.F
    values = F.concat(F.array(queries.text("=part:", F.col("k"))), F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: queries.text(F.col("k"), " ", i)))
    d = queries.dump(queries.lines(rows, F.col("k"), values), queries.lines(rows, F.col("k"), F.array(queries.text("=more:", F.col("k")), F.lit("x")), 1))
    got = d.section_lines.filter("kind = 'part' and not is_header").select("key", "line_no", "value").orderBy("line_no").collect()
    assert [r.value for r in got] == [f"{k} {i}" for k, n in ((1, 70_000), (2, 3), (3, 140_000)) for i in range(1, n + 1)]
    assert all(r.value.startswith(r.key + " ") for r in got)
    assert [r.key for r in d.section_lines.filter("kind = 'more' and not is_header").orderBy("line_no").collect()] == ["1", "2", "3"]


def test_chain_of_many_items(spark, tmp_path):
    rows = [(k, i, 10 * k + i) for k in (1, 2, 3) for i in range(40)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = dict(map(tuple, queries.pointer_chase(spark, str(tmp_path)).select("key", "text").collect()))
    assert got == {str(k): "[" + ",".join(str(1000 + 10 * k + i) for i in range(40)) + "]" for k in (1, 2, 3)}


def test_formatting(spark):
    F = fmt.F
    one = spark.range(1)

    def value(column):
        return one.select(column.alias("x")).first().x

    assert [value(fmt.bytes_text(F.lit(n))) for n in (0, 1023, 1024, 1280, 1 << 20, 3 << 30)] == ["0B", "1023B", "1.0K", "1.2K", "1.0M", "3.0G"]
    assert value(fmt.words_to_bytes(F.lit("18446744073709551615").cast("decimal(20,0)"))) == 18446744073709551615
    assert [value(fmt.unsigned(F.lit(t))) for t in ("5", "+5", "-5", " 5", "18446744073709551616", "x")] == [5, 5, None, None, None, None]
    assert [value(fmt.address(F.lit(t))) for t in ("FF", "+0", "000000000000000000ff", "10000000000000000", "0x1", "")] == ["00000000000000ff", "0" * 16, "00000000000000ff", None, None, None]
    assert value(fmt.url_encoded(F.lit("a b*~/é"))) == "a%20b%2A~%2F%C3%A9"
    assert [value(fmt.truncated(F.lit("héllo"), n)) for n in (0, 1, 3, 5)] == ["", "…", "hé…", "héllo"]
    assert value(fmt.byte_list(F.lit(b"\x00\xff"))) == "[00, ff]"


def test_only_the_entry_knows_of_llm():
    for path in [*ROOT.glob("cairn/*.py"), *ROOT.glob("cairn/[!l]*/*.py"), ROOT / "bench.py"]:
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or n == "corpus_pipeline" for n in names), path
