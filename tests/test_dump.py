import gzip
import lzma

import pytest
import zstandard

from cairn.functions.fmt import Pager
from cairn.operators import heap
from cairn.operators.dump import Dump
from cairn.sources.catalog import Catalog, Jobs, fingerprint
from cairn.sources.lines import numbered, read_lines

EXAMPLE = """stray line
=erl_crash_dump:0.5
=memory
total: 4096
processes: +5
bad: x
total: 7
=proc:<0.1.0>
State: Waiting
Name: first name
Memory: 2048
Link list: [<0.2.0>, <0.3.0>]
=proc:<0.2.0>
=proc_stack:<0.1.0>
y0:H1000
0xff:SReturn addr

x1:Q?
=proc_dictionary:<0.1.0>
t1:N
A5:hello
=proc_messages:<0.1.0>
H1040:N
?
I7
=proc_heap:<0.1.0>
1000:t2:A2:ok,H1010
1010:lI104|H1020
  1020:lI105|N
1040:Yc2000:0:5
1040:I9
zz:N
nocolon
=binary:2000
5:aGVsbG8=
second:line
=binary:2001
5:aGVsbG8
=binary:xyz
5:aGVsbG8=
=empty:section
=:nokind
dropped
=end
after the end
"""


def dump_of(spark, text, block=4):
    rows = [("d", i, line) for i, line in enumerate(text.split("\n"))]
    return Dump(numbered(spark.createDataFrame(rows, "dump_id string, line_no long, value string"), block))


@pytest.fixture(scope="module")
def dump(spark):
    return dump_of(spark, EXAMPLE)


def test_processes(dump):
    (one,) = dump.processes().orderBy("rank").collect()  # a section without lines isn't there
    assert (one.pid, one.name, one.state, one.memory, one.links, one.monitors) == ("<0.1.0>", "first name", "Waiting", 2048, ["<0.2.0>", "<0.3.0>"], [])
    assert [r.pid for r in dump.processes(q="FIRST").collect()] == ["<0.1.0>"]
    assert dump.display(dump.processes()).filter("rank = 1").first().short_name == "first"


def test_details(dump):
    d = dump.details("<0.1.0>").first()
    assert [(s.label, s.term_text, s.raw) for s in d.stack] == [("y0", '{ok,"hi"}', "H1000"), ("0xff", None, "SReturn addr"), ("x1", None, "Q?")]
    assert [m.term_text for m in d.messages] == ['<<"hello">>', "7"]
    assert [m.term_text for m in d.dictionary] == ["{[]}"]
    fixed = dump.term_lines("proc_dictionary", compat=False).orderBy("n").collect()
    assert [r.term_text for r in fixed] == ["{[]}", "hello"]


def test_pages(dump):
    page = dump.messages_page("<0.1.0>", 0, 2).collect()
    assert [(r.n, r.total, r.term_text) for r in page] == [(0, 3, '<<"hello">>')]
    assert dump.stack_page("<0.1.0>", 3, 5).collect() == []
    assert [r.value for r in dump.line_page("proc_stack", "<0.1.0>", 1, 1).collect()] == ["0xff:SReturn addr"]
    p = Pager(10, 4, 4)
    assert (p.has_prev, p.has_next, p.prev_offset, p.next_offset, p.total_pages, p.last_page, p.start, p.end) == (True, True, 0, 8, 3, 2, 5, 8)
    assert Pager(3, 0, 0).total_pages == 0


def test_memory_and_figures(dump):
    assert [(r.key, r.bytes) for r in dump.memory().orderBy("ord").collect()] == [("total", 4096), ("processes", 5), ("total", 7)]
    assert dump.memory_total().first().total == 4096 and dump.memory_total(last=True).first().total == 7
    s = dump.stats().first()
    assert (s.heap_entries, s.binary_entries, s.literal_entries, s.duplicates, s.incomplete) == (5, 1, 0, 1, False)
    o = dump.overview().first()
    assert (o.total, o.processes_bytes, o.code, o.process_count) == (4096, 5, 0, 1)


def test_sections(dump):
    rows = {(r.kind, r.key): (r.line_count, r.size_bytes) for r in dump.sections().collect()}
    assert rows["proc_stack", "<0.1.0>"] == (3, 9 + 18 + 1 + 6)
    assert ("empty", "section") not in rows and ("", "nokind") not in rows
    assert dump.has_section("memory") and not dump.has_section("memory", "x")
    assert [r.value for r in dump.query("proc_messages", "<0.1.0>").collect()] == ["H1040:N", "?", "I7"]
    assert dump.section_lines.filter("value like 'after%' or value = 'dropped' or value = 'stray line'").count() == 0


def test_incomplete(spark):
    d = dump_of(spark, "=a:b\nx\n=c")
    assert {(r.kind, r.key) for r in d.sections().collect()} == {("a", "b"), ("_meta", "incomplete")}
    assert d.stats().first().text == "heap=0 binaries=0 literals=0 text_sections=2 [INCOMPLETE — no =end marker]"


def test_lookup(dump):
    assert dump.lookup("0x1000").first().text == "t2:A2:ok,H1010"
    assert dump.lookup("1040").first().text == "Yc2000:0:5"
    assert not dump.lookup("9").first().found


def test_joined_decoding_agrees(dump):
    rows = heap.labelled(dump.kind("proc_stack", "proc_messages")).withColumn("term", heap.F.when(heap.F.col("value").startswith("H"), heap.F.col("value")).otherwise(heap.F.col("raw")))
    near = heap.decode(rows, dump.access).select("line_no", "term_text", "term_json")
    far = heap.decode_joined(rows, dump.addresses).select("line_no", "term_text", "term_json")
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect()))


def chains(spark, sizes):
    """Dumps whose probes point to lists of so many cells, a cycle, a missing cell, an atom that looks like a pointer and two lists at once."""
    cells = [(f"{n * 65536 + i * 16:x}", f"lI{1000 + i}|" + (f"H{n * 65536 + i * 16 + 16:x}" if i < n - 1 else "N")) for n in sizes for i in range(n)]
    more = [("9000000", "t2:H9000010,Hdead"), ("9000010", "lI1|H9000020"), ("9000020", "lI2|H9000010"), ("9000030", "A5:H9000")]
    probes = [f"H{n * 65536:x}" for n in sizes] + ["H9000000", "H9000010", "H9000030", "t2:H30000,Hc80000", "Hffffffffffffffffff", "I7", "Q", "Hbeef", "lH30000|Hc80000"]
    text = "\n".join(["=probe:a", *(f"y{i}:{p}" for i, p in enumerate(probes)), "=proc_heap:b", *(f"{a}:{t}" for a, t in cells + more), "=end"])
    rows = [(d, i, v) for d in ("d", "e") for i, v in enumerate(text.replace("I1000|", "I2000|" if d == "e" else "I1000|").split("\n"))]
    return Dump(numbered(spark.createDataFrame(rows, "dump_id string, line_no long, value string")))


@pytest.mark.parametrize("entries", [1, 7, 100_000])
def test_decoding_from_block_to_block(spark, monkeypatch, entries):
    monkeypatch.setattr(heap, "BLOCK_ENTRIES", entries)
    d = chains(spark, (3, 127, 128, 129, 200) if entries > 1 else (3, 5)).materialized()
    rows = heap.labelled(d.kind("probe")).withColumn("term", heap.F.when(heap.F.col("raw") != "Q", heap.F.col("raw")))
    far = heap.Access(d.addresses, limit=0)
    assert far.sent is None and (len(far.blocks.paths) > 10) == (entries < 100)
    columns = ("dump_id", "line_no", "term_text", "term_json", "term_error")
    near = heap.decode(rows, d.access).select(*columns).collect()
    assert len(near) == 2 * rows.filter("dump_id = 'd'").count() and (entries == 1 or any("...depth limit..." in r.term_text for r in near if r.term_text))
    assert sorted(map(str, near)) == sorted(map(str, heap.decode(rows, far).select(*columns).collect()))


def test_chains_in_a_block_take_no_rounds(spark):
    d = chains(spark, (3, 100, 200)).materialized()
    rows = heap.labelled(d.kind("probe")).withColumn("term", heap.F.col("raw"))
    spark.sparkContext.setJobGroup("chains", "")
    assert heap.decode_joined(rows, d.addresses).filter("term_text is not null").count() > 10
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chains"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 30, jobs


def test_stretches_of_blocks(spark, monkeypatch):
    from cairn import dumpgen

    monkeypatch.setattr(dumpgen, "STRETCH", 3)
    monkeypatch.setattr(dumpgen, "BLOCK", 2)
    k = heap.F.col("id")
    some = heap.F.when(k % 4 == 0, heap.F.array(dumpgen.text("=a:", k), heap.F.lit(""), heap.F.lit("x"))).otherwise(heap.F.array(dumpgen.text("v", k), heap.F.lit("w"), heap.F.lit(""), heap.F.lit("z"), heap.F.lit("z")))
    lines = dumpgen.dump(dumpgen.lines(spark.range(40), k, some), dumpgen.lines(spark.range(5, 30), k, some, 1)).lines
    assert lines.select("stretch").distinct().count() > 20
    one = [tuple(r) for r in Dump(lines).all_sections.orderBy("line_no").collect()]
    assert one == [tuple(r) for r in Dump(lines.drop("stretch")).all_sections.orderBy("line_no").collect()]
    assert [r[4] for r in one] == list(range(len(one))) and len(one) > 250


def test_decoded(dump):
    assert [r.text for r in dump.decoded("proc_messages").orderBy("line_no").collect()] == ['<<"hello">>', "?", "7"]
    assert dump.decoded("proc_dictionary").orderBy("line_no").collect()[1].text == "A5:hello"


def test_empty(spark):
    d = Dump(numbered(spark.createDataFrame([], "dump_id string, line_no long, value string")))
    assert d.processes().count() == d.sections().count() == d.stats().count() == d.memory().count() == 0


CODECS = {"plain": lambda b: b, "gzip": gzip.compress, "xz": lzma.compress, "zstd": lambda b: zstandard.ZstdCompressor().compress(b)}


@pytest.mark.parametrize("codec", CODECS)
def test_codecs(spark, tmp_path, codec):
    raw = EXAMPLE.replace("\n", "\r\n").encode()
    paths = {}
    for name in ("d.dump", "d.dump.gz"):
        (tmp_path / name).write_bytes(CODECS[codec](raw))
        paths[name] = str(tmp_path / name)
    for r in Dump(read_lines(spark, paths)).processes(top=1).collect():
        assert (r.pid, r.memory) == ("<0.1.0>", 2048)
    assert Dump(read_lines(spark, paths)).processes(top=1).count() == 2


def test_not_utf8(spark, tmp_path):
    (tmp_path / "bad").write_bytes(b"=a\n\xff\xfe\n=end\n")
    with pytest.raises(Exception, match="UTF-8"):
        read_lines(spark, {"d": str(tmp_path / "bad")}).collect()


def test_many_blocks_agree(spark, tmp_path):
    path = tmp_path / "long.dump"
    path.write_text("".join(f"=s:{i}\n" + "".join(f"line {i} {j}\n" for j in range(i % 50)) for i in range(400)) + "=end\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = read_lines(spark, {"d": str(path)})
        assert lines.select("block").distinct().count() > 3
        counts = {int(r.key): r.line_count for r in Dump(lines).sections().collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert counts == {i: i % 50 for i in range(400) if i % 50}


def test_catalog(spark, tmp_path):
    path = tmp_path / "my.dump"
    path.write_text(EXAMPLE)
    c = Catalog(spark, str(tmp_path / "store"))
    assert c.list().count() == 0
    dump_id = c.ingest(str(path))
    assert dump_id == fingerprint(spark, str(path)) and len(dump_id) == 16
    assert c.resolve(dump_id[:5]) == dump_id
    with pytest.raises(LookupError):
        c.resolve("zz")
    with pytest.raises(ValueError):
        c.folder("../x")
    d = c.open(str(path))
    assert d.processes(top=1).first().memory == 2048 and d.stack().filter("label = 'y0'").first().term_text == '{ok,"hi"}'
    c.set_label(dump_id, " mine ")
    assert c.list().first().label == "mine"
    jobs = Jobs(c)
    job = jobs.get(jobs.submit(str(tmp_path / "missing")))
    job.thread.join()
    assert job.status == "failed" and job.events[-1]["event"] == "error"
    assert c.drop(dump_id) and c.list().count() == 0


def test_compressed_dumps_have_blocks(spark, tmp_path):
    text = "".join(f"=s:{i}\n" + "".join(f"{i} {j}\n" for j in range(i * 9000)) + "\n" for i in range(6)) + "=end\n"
    (tmp_path / "d").write_bytes(gzip.compress(text.encode(), 1))
    lines = read_lines(spark, {"d": str(tmp_path / "d")})
    assert lines.select("block").distinct().count() == 3
    d = Dump(lines)
    assert {r.key: r.line_count for r in d.sections().collect()} == {str(i): i * 9000 for i in range(6)}
    assert [(r.n, r.total, r.value) for r in d.line_page("s", "5", 44_998, 5).orderBy("n").collect()] == [(44_998, 45_000, "5 44998"), (44_999, 45_000, "5 44999")]
    assert [r["rank"] for r in d.sections("key").orderBy("key").collect()] == [1, 2, 3, 4, 5, 6]


def test_stored_dump_reads_its_tables(spark, tmp_path):
    (tmp_path / "d").write_text(EXAMPLE)
    told = []
    c = Catalog(spark, str(tmp_path / "store"))
    d = c.open(c.ingest(str(tmp_path / "d"), told=lambda step, about: told.append(step)))
    assert told == ["fingerprint", "sections", "catalogue", "addresses"]
    plan = d.line_page("proc_stack", "<0.1.0>", 1, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "PushedFilters" in plan
    assert d.catalogue._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    assert [r.value for r in d.line_page("proc_stack", "<0.1.0>", 1, 1).collect()] == ["0xff:SReturn addr"]
    assert [[r.term_text for r in page] for page in d.pages("messages", "<0.1.0>", 1)] == [['<<"hello">>'], [], ["7"]]
    assert [r.banner for r in d.query("proc_messages", "<0.1.0>", banners=True).limit(1).collect()] == ["=== proc_messages:<0.1.0> ==="]
    assert [r.term_text for r in d.shortened(d.stack_page("<0.1.0>", 0, 1), 4).collect()] == ["{ok…"]
    assert '"term":{"t":"tuple"' in d.as_json(d.stack_page("<0.1.0>", 0, 1)).first().json


def test_store_stays_where_it_is(dump):
    store, name = heap.bucketed(dump.addresses)
    spark = dump.spark
    frontier = spark.createDataFrame([("d", "0" * 12 + "1000")], "dump_id string, addr string")
    plan = frontier.join(store, ["dump_id", "addr"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan, plan
    spark.sql(f"DROP TABLE {name}")


def test_known_fingerprints():
    from cairn.sources.catalog import fnv1a

    assert [f"{fnv1a(x):016x}" for x in (b"", b"a", b"foobar")] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]


def test_long_term_json(spark):
    d = dump_of(spark, "=probe:a\ny0:Yh" + hex(150_000)[2:] + ":" + "AAAA" * 50_000 + "\n=end")
    (row,) = heap.decode(heap.labelled(d.kind("probe")).withColumn("term", heap.F.col("raw")), d.access).collect()
    assert row.term_json is None and row.term_text.startswith("<<0,0,")
