"""Queries by name, each over tables rendered as a dump and read by the engine; and SQL that answers from the tables alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .dumpgen import atom, dump, encoded, hexadecimal, lines, pid, string_lines, table, text
from .functions import fmt
from .operators import heap
from .operators.dump import Dump
from .sources.catalog import Catalog, StoredDump
from .sources.shared import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# processes

CENTS = "CAST(round(abs(c_acctbal) * 100) AS BIGINT)"
PID = "'<0.' || c_custkey || '.0>'"


def process_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return lines(c, k, F.array(
        text("=proc:", pid(k)), text("State: ", F.col("c_mktsegment")), F.when(k % 5 != 0, text("Name: ", F.col("c_name"))).otherwise(F.lit("Unknown: x")),
        text("Spawned as: mod", k % 11, ":init/1"), text("Spawned by: ", pid(F.col("c_nationkey"))), text("Message queue length: ", k % 7), text("Stack+heap: ", k * 13),
        text("OldHeap: ", k * 3), text("Heap unused: ", k), text("Memory: ", F.round(F.abs("c_acctbal") * 100).cast("long")), text("Reductions: ", k * 101), text("Program counter: 0x", hexadecimal(k)), text("arity: ", k % 4),
        text("Link list: [", pid(k + 1), ", ", pid(k + 2), "]"), F.lit("Monitor list: []"),
    ))


def processes(spark: SparkSession, sf_dir: str) -> Dump:
    return dump(process_lines(spark, sf_dir))


PROCESS_SQL = f"""SELECT {PID} AS pid, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS name, c_mktsegment AS state, 'mod' || (c_custkey % 11) || ':init/1' AS spawned_as,
 '<0.' || c_nationkey || '.0>' AS spawned_by, c_custkey % 7 AS mqueue_len, c_custkey * 13 AS stack_heap, c_custkey * 3 AS old_heap, c_custkey AS heap_unused, {CENTS} AS memory,
 c_custkey * 101 AS reductions, '0x' || lower(to_hex(c_custkey)) AS program_counter, CAST(c_custkey % 4 AS INTEGER) AS arity, '<0.' || (c_custkey + 1) || '.0>,<0.' || (c_custkey + 2) || '.0>' AS links,
 '' AS monitors FROM customer"""


def _processes_flat(df: DataFrame) -> DataFrame:
    return df.drop("dump_id", "section_id").withColumn("links", F.array_join("links", ",")).withColumn("monitors", F.array_join("monitors", ","))


@query(f"SELECT *, row_number() OVER (ORDER BY memory DESC, pid) AS rank FROM ({PROCESS_SQL})")
def proc_list(spark, sf_dir):
    return _processes_flat(processes(spark, sf_dir).processes())


@query(f"SELECT *, row_number() OVER (ORDER BY pid) AS rank FROM ({PROCESS_SQL})")
def proc_by_pid(spark, sf_dir):
    return _processes_flat(processes(spark, sf_dir).processes(sort_by="pid"))


@query(f"SELECT *, row_number() OVER (ORDER BY memory DESC, pid) AS rank FROM ({PROCESS_SQL}) WHERE contains(lower(pid), 'er#0000001') OR contains(lower(coalesce(name, '')), 'er#0000001') OR contains(lower(spawned_as), 'er#0000001') OR contains(lower(state), 'er#0000001')")
def proc_filter(spark, sf_dir):
    return _processes_flat(processes(spark, sf_dir).processes(q="ER#0000001"))


@query(f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY memory DESC, pid) AS rank FROM ({PROCESS_SQL})) WHERE rank <= 10")
def proc_top10(spark, sf_dir):
    return _processes_flat(processes(spark, sf_dir).processes(top=10))


def bytes_sql(n: str) -> str:
    """Tenths in whole numbers, ties to even."""

    def tenths(bits: int) -> str:
        q, half = f"(({n}) * 10 // {1 << bits})", f"(({n}) * 10 % {1 << bits})"
        t = f"({q} + CASE WHEN {half} > {1 << (bits - 1)} OR ({half} = {1 << (bits - 1)} AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
        return f"({t} // 10) || '.' || ({t} % 10)"

    return f"CASE WHEN {n} >= {1 << 30} THEN {tenths(30)} || 'G' WHEN {n} >= {1 << 20} THEN {tenths(20)} || 'M' WHEN {n} >= {1 << 10} THEN {tenths(10)} || 'K' ELSE ({n}) || 'B' END"


@query(f"SELECT pid, coalesce(name, spawned_as) AS display_name, coalesce(name, spawned_as) AS short_name, {bytes_sql('memory')} AS memory_text, CAST(stack_heap * 8 AS BIGINT) AS stack_heap_bytes, stack_heap || ' words (' || {bytes_sql('stack_heap * 8')} || ')' AS stack_heap_text FROM ({PROCESS_SQL})")
def proc_display(spark, sf_dir):
    d = processes(spark, sf_dir)
    return d.display(d.processes()).select("pid", "display_name", "short_name", "memory_text", F.col("stack_heap_bytes").cast("long").alias("stack_heap_bytes"), "stack_heap_text")


@query("""SELECT '<0.' || s_suppkey || '.0>' AS pid, CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN s_suppkey WHEN 2 THEN 0 ELSE 7 END AS memory, s_suppkey * 2 AS reductions, CAST(0 AS BIGINT) AS mqueue_len, 'B' || s_suppkey AS name FROM supplier""")
def proc_defaults(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    memory = F.when(k % 4 == 0, text("Memory: -", k)).when(k % 4 == 1, text("Memory: +", k)).when(k % 4 == 2, F.lit("Memory: 12x")).otherwise(F.lit("Memory:   7 "))
    d = dump(lines(s, k, F.array(text("=proc:", pid(k)), text("Name: A", k), memory, text("Reductions: ", k), F.lit("Message queue length: 99999999999999999999"), text("Reductions: ", k * 2), text("Name: B", k))))
    return d.processes().select("pid", "memory", "reductions", F.col("mqueue_len"), "name")


STACK_SQL = "'{' || o_orderstatus_q || ',' || o_orderkey || '}'"


def detail_dump(spark: SparkSession, sf_dir: str) -> Dump:
    o = table(spark, sf_dir, "orders")
    rows = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("os"))
    k = F.col("o_custkey")
    stack = F.concat(F.array(text("=proc_stack:", pid(k))), F.transform("os", lambda x: F.concat(F.lit("y"), (x["o_orderkey"] % 10).cast("string"), F.lit(":t2:A1:"), x["o_orderstatus"], F.lit(",I"), x["o_orderkey"].cast("string"))), F.array(F.lit("0xff00:SReturn addr 0x1 (mod:f/1)"), F.lit("")))
    messages = F.concat(F.array(text("=proc_messages:", pid(k))), F.transform("os", lambda x: F.when(x["o_orderkey"] % 3 == 0, F.lit("?bad")).otherwise(F.concat(F.lit("I"), x["o_orderkey"].cast("string")))))
    words = F.concat(F.array(text("=proc_dictionary:", pid(k))), F.transform("os", lambda x: F.concat(F.lit("t2:A3:key,I"), x["o_orderkey"].cast("string"))))
    return dump(process_lines(spark, sf_dir), lines(rows, k, stack, 1), lines(rows, k, messages, 2), lines(rows, k, words, 3))


@query(f"""SELECT {PID} AS pid, coalesce(n, 0) + CASE WHEN n IS NULL THEN 0 ELSE 1 END AS n_stack, coalesce(m, 0) AS n_messages, coalesce(n, 0) AS n_dictionary, first AS first_term FROM customer LEFT JOIN
 (SELECT o_custkey, count(*) AS n, count(CASE WHEN o_orderkey % 3 <> 0 THEN 1 END) AS m, arg_min('{{''' || o_orderstatus || ''',' || o_orderkey || '}}', o_orderkey) AS first FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def proc_detail_join(spark, sf_dir):
    out = detail_dump(spark, sf_dir).materialized().details()
    return out.select("pid", F.size("stack").cast("long").alias("n_stack"), F.size("messages").cast("long").alias("n_messages"), F.size("dictionary").cast("long").alias("n_dictionary"), F.get("stack", F.lit(0))["term_text"].alias("first_term"))


@query("""SELECT '<0.' || o_custkey || '.0>' AS pid, n - 1 AS n, t + 1 AS total, 'y' || (o_orderkey % 10) AS label, '{''' || o_orderstatus || ''',' || o_orderkey || '}' AS term_text FROM
 (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderstatus) AS n, count(*) OVER (PARTITION BY o_custkey) AS t FROM orders) WHERE n - 1 BETWEEN 2 AND 4
 UNION ALL SELECT '<0.' || o_custkey || '.0>', count(*), count(*) + 1, '0xff00', NULL FROM orders GROUP BY o_custkey HAVING count(*) BETWEEN 2 AND 4""")
def stack_page(spark, sf_dir):
    return detail_dump(spark, sf_dir).stack(offset=2, limit=3).select("pid", "n", "total", "label", "term_text")


@query("""SELECT '<0.' || o_custkey || '.0>' AS pid, n - 1 AS n, t AS total, CAST(o_orderkey AS VARCHAR) AS term_text FROM
 (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderstatus) AS n, count(*) OVER (PARTITION BY o_custkey) AS t FROM orders) WHERE n - 1 BETWEEN 1 AND 5 AND o_orderkey % 3 <> 0""")
def message_page(spark, sf_dir):
    d = detail_dump(spark, sf_dir)
    return d.term_lines("proc_messages", offset=1, limit=5).select("pid", "n", "total", "term_text")


@query("SELECT '<0.' || o_custkey || '.0>' AS pid, '{key,' || o_orderkey || '}' AS term_text FROM orders")
def dictionary_terms(spark, sf_dir):
    return detail_dump(spark, sf_dir).term_lines("proc_dictionary").select("pid", "term_text")


@query("""SELECT '<0.' || o_custkey || '.0>' AS key, CASE WHEN o_orderkey % 3 = 0 THEN '?bad' ELSE CAST(o_orderkey AS VARCHAR) END AS text FROM orders""")
def decode_section(spark, sf_dir):
    return detail_dump(spark, sf_dir).decoded("proc_messages").select("key", "text")


# tables and memory


def ets_dump(spark: SparkSession, sf_dir: str) -> Dump:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    yes = lambda c: F.when(c, "true").otherwise("false")
    return dump(lines(s, k, F.array(
        text("=ets:", pid(F.col("s_nationkey"))), text("Name: ", F.col("s_name")), F.lit("Type: set"), F.when(k % 2 == 0, "Protection: public").otherwise("Protection: private"), text("Objects: ", k * 5),
        text("Words: ", F.round(F.abs("s_acctbal") * 100).cast("long")), F.when(k % 3 == 0, F.lit("Buckets: none")).otherwise(text("Buckets: ", k)), text("Write Concurrency: ", yes(k % 2 == 0)),
        text("Read Concurrency: ", yes(k % 3 == 0)), text("Compressed: ", yes(k % 5 == 0)), F.when(k % 7 == 0, "Fixed: TRUE").otherwise("Fixed: false"),
    )))


ETS_SQL = """SELECT '<0.' || s_nationkey || '.0>' AS owner_pid, s_name AS name, 'set' AS table_type, CASE WHEN s_suppkey % 2 = 0 THEN 'public' ELSE 'private' END AS protection, s_suppkey * 5 AS objects,
 CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS words, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey END AS buckets, s_suppkey % 2 = 0 AS write_concurrency, s_suppkey % 3 = 0 AS read_concurrency,
 s_suppkey % 5 = 0 AS compressed, false AS fixed FROM supplier"""


@query(f"SELECT * REPLACE (coalesce(buckets, -1) AS buckets), row_number() OVER (ORDER BY words DESC, name, owner_pid) AS rank FROM ({ETS_SQL})")
def ets_list(spark, sf_dir):
    return ets_dump(spark, sf_dir).ets().select("owner_pid", "name", "table_type", "protection", "objects", "words", F.coalesce("buckets", F.lit(-1)).alias("buckets"), "write_concurrency", "read_concurrency", "compressed", "fixed", "rank")


@query("SELECT '<0.' || s_nationkey || '.0>' AS owner_pid, count(*) AS tables, CAST(sum(CAST(round(abs(s_acctbal) * 100) AS BIGINT)) AS BIGINT) AS words FROM supplier GROUP BY s_nationkey")
def ets_multi_owner(spark, sf_dir):
    return ets_dump(spark, sf_dir).ets().groupBy("owner_pid").agg(F.count("*").alias("tables"), F.sum("words").alias("words"))


@query(f"""SELECT name, coalesce(nullif(concat_ws(', ', CASE WHEN write_concurrency THEN 'write_concurrency' END, CASE WHEN read_concurrency THEN 'read_concurrency' END, CASE WHEN compressed THEN 'compressed' END), ''), '-') AS flags,
 CASE WHEN write_concurrency THEN 'W' ELSE '' END || CASE WHEN read_concurrency THEN 'R' ELSE '' END || CASE WHEN compressed THEN 'C' ELSE '' END AS flag_letters, words || ' (' || {bytes_sql('words * 8')} || ')' AS memory_text FROM ({ETS_SQL})""")
def ets_flags(spark, sf_dir):
    return ets_dump(spark, sf_dir).ets().select("name", "flags", "flag_letters", "memory_text")


def memory_dump(spark: SparkSession, sf_dir: str) -> Dump:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    head = lines(n.filter("n_nationkey = 0"), F.lit(0), F.array(F.lit("=memory")))
    body = lines(n, k + 1, F.array(text(F.lower("n_name"), ": ", k * 1000), text("note: ", F.col("n_name")), F.when(k % 5 == 0, text("total: ", k + 7)).otherwise(F.lit("no number here"))))
    return dump(head, body)


MEMORY_SQL = """SELECT row_number() OVER (ORDER BY n_nationkey, part) AS ord, key, bytes FROM (SELECT n_nationkey, 0 AS part, lower(n_name) AS key, CAST(n_nationkey * 1000 AS BIGINT) AS bytes FROM nation
 UNION ALL SELECT n_nationkey, 1, 'total', n_nationkey + 7 FROM nation WHERE n_nationkey % 5 = 0)"""


@query(f"SELECT ord, key, bytes FROM ({MEMORY_SQL})")
def memory_view(spark, sf_dir):
    return memory_dump(spark, sf_dir).memory().drop("dump_id")


@query(f"SELECT arg_min(bytes, ord) AS first_total, arg_max(bytes, ord) AS last_total FROM ({MEMORY_SQL}) WHERE key = 'total'")
def memory_total(spark, sf_dir):
    d = memory_dump(spark, sf_dir)
    return d.memory_total().select("dump_id", F.col("total").alias("first_total")).join(d.memory_total(last=True).select("dump_id", F.col("total").alias("last_total")), "dump_id").drop("dump_id")


@query(f"SELECT key, arg_max(bytes, ord) AS bytes FROM ({MEMORY_SQL}) GROUP BY key")
def memory_map(spark, sf_dir):
    return memory_dump(spark, sf_dir).memory_map().drop("dump_id")


@query("SELECT CAST(7 AS BIGINT) AS total, CAST(0 AS BIGINT) AS code, CAST(0 AS BIGINT) AS process_count, false AS incomplete")
def overview(spark, sf_dir):
    return memory_dump(spark, sf_dir).overview().select("total", "code", "process_count", "incomplete")


# sections

DOC_LINES = """SELECT doc_id, lang, i, regexp_replace(regexp_replace(x, '^=', ' ='), '\\r+$', '') AS line FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"""


def document_dump(spark: SparkSession, sf_dir: str, ending: str = "") -> Dump:
    d = table(spark, sf_dir, "documents")
    values = F.concat(F.array(text("=doc_", F.col("lang"), ":k:", F.col("doc_id"))), string_lines(F.col("text")))
    return dump(lines(d, F.col("doc_id"), F.transform(values, lambda x: F.concat(x, F.lit(ending))) if ending else values))


@query(f"SELECT 'doc_' || lang AS kind, 'k:' || doc_id AS key, count(CASE WHEN line <> '' THEN 1 END) AS line_count, CAST(sum(strlen(line) + 1) AS BIGINT) AS size_bytes FROM ({DOC_LINES}) GROUP BY lang, doc_id")
def section_catalog(spark, sf_dir):
    return document_dump(spark, sf_dir).sections().select("kind", "key", "line_count", "size_bytes")


@query(f"SELECT kind, key, row_number() OVER (ORDER BY kind, key) AS by_kind, row_number() OVER (ORDER BY size_bytes DESC, kind, key) AS by_size FROM (SELECT 'doc_' || lang AS kind, 'k:' || doc_id AS key, sum(strlen(line) + 1) AS size_bytes FROM ({DOC_LINES}) GROUP BY lang, doc_id)")
def section_order(spark, sf_dir):
    d = document_dump(spark, sf_dir)
    return d.sections("kind").select("kind", "key", F.col("rank").alias("by_kind")).join(d.sections().select("kind", "key", F.col("rank").alias("by_size")), ["kind", "key"])


@query(f"SELECT 'doc_' || lang AS kind, count(DISTINCT doc_id) AS entries, CAST(sum(strlen(line) + 1) AS BIGINT) AS total_bytes FROM ({DOC_LINES}) GROUP BY lang")
def section_groups(spark, sf_dir):
    return document_dump(spark, sf_dir).section_groups().select("kind", "entries", "total_bytes")


@query(f"SELECT doc_id, n - 1 AS n, t AS total, line AS value FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, count(*) OVER (PARTITION BY doc_id) AS t FROM ({DOC_LINES}) WHERE line <> '' AND lang = 'en') WHERE n - 1 BETWEEN 3 AND 7")
def line_page(spark, sf_dir):
    d = document_dump(spark, sf_dir)
    rows = d.numbered_lines(d.kind("doc_en"))
    return d.page(rows, 3, 5).select(F.substring_index("key", ":", -1).cast("long").alias("doc_id"), "n", "total", "value")


@query(f"SELECT 'k:' || doc_id AS key, line AS value, row_number() OVER (ORDER BY i) AS place FROM ({DOC_LINES}) WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE lang = 'de')")
def section_query(spark, sf_dir):
    from pyspark.sql import Window

    first = table(spark, sf_dir, "documents").filter("lang = 'de'").agg(F.min("doc_id")).first()[0]
    return document_dump(spark, sf_dir).query("doc_de", f"k:{first}").select("key", "value", F.row_number().over(Window.partitionBy("section_id").orderBy("line_no")).cast("long").alias("place"))


@query(f"SELECT doc_id, count(*) AS lines, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM ({DOC_LINES}) GROUP BY doc_id")
def crlf_lines(spark, sf_dir):
    d = document_dump(spark, sf_dir, "\r")
    return d.section_lines.groupBy(F.substring_index("key", ":", -1).cast("long").alias("doc_id")).agg(F.count("*").alias("lines"), F.sum(F.octet_length("value")).alias("bytes"))


@query("SELECT 'conv' AS kind, CAST(conv_id AS VARCHAR) AS key, arg_max(role || ' ' || replace(text, chr(10), ' '), turn) AS last_value, count(*) AS n FROM conversations GROUP BY conv_id")
def conversation_sections(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    values = F.concat(F.array(text("=conv:", F.col("conv_id"))), F.transform("t", lambda x: F.concat(x["role"], F.lit(" "), F.replace(x["text"], F.lit("\n"), F.lit(" ")))))
    return dump(lines(rows, F.col("conv_id"), values)).section_lines.groupBy("kind", "key").agg(F.max_by("value", "line_no").alias("last_value"), F.count("*").alias("n"))


# addresses


def heap_dump(spark: SparkSession, sf_dir: str) -> Dump:
    """Words in two processes' heaps, some of them twice; literals; binaries; and lines that are none of these."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    head = lambda s, part: lines(spark.range(1), F.lit(0), F.array(F.lit(s)), part)
    words = lines(p, k + 1, F.array(text(hexadecimal(k * 16), ":I", F.col("p_size")), F.when(k % 10 == 0, text("zz", k, ":N")).otherwise(F.lit("   "))), 1)
    again = lines(p.filter("p_partkey % 4 = 0"), k + 1, F.array(text("  000", F.upper(hexadecimal(k * 16)), ":I99999")), 2)
    literals = lines(p.filter("p_partkey % 5 = 0"), k + 1, F.array(text(hexadecimal(k * 16 + (1 << 40)), ":", atom(F.col("p_brand")))), 3)
    code = encoded(F.col("p_name"))
    binaries = lines(p, k + 1, F.array(text("=binary:", hexadecimal(k * 16 + (1 << 41))), F.when(k % 6 == 0, text("5:", F.rtrim(code, F.lit("=")))).otherwise(text(hexadecimal(F.octet_length("p_name").cast("long")), ":", code)), F.lit("ignored:line")), 4)
    return dump(head("=proc_heap:<0.1.0>", 1), words, head("=proc_heap:<0.2.0>", 2), again, head("=literals", 3), literals, binaries)


BAD64 = "(p_partkey % 6 = 0 AND strlen(p_name) % 3 <> 0)"


@query(f"""SELECT count(*) + count(CASE WHEN p_partkey % 4 = 0 THEN 1 END) AS heap_entries, count(CASE WHEN NOT {BAD64} THEN 1 END) AS binary_entries, count(CASE WHEN p_partkey % 5 = 0 THEN 1 END) AS literal_entries,
 count(CASE WHEN p_partkey % 4 = 0 THEN 1 END) AS duplicates, CAST(0 AS BIGINT) AS text_sections, false AS incomplete FROM part""")
def ingest_stats(spark, sf_dir):
    return heap_dump(spark, sf_dir).stats().select("heap_entries", "binary_entries", "literal_entries", "duplicates", "text_sections", "incomplete")


@query("SELECT lpad(lower(to_hex(p_partkey * 16)), 16, '0') AS addr, 'I' || p_size AS blob FROM part")
def addr_dedup(spark, sf_dir):
    return heap_dump(spark, sf_dir).addresses.filter("source = 'proc_heap'").select("addr", F.col("blob").cast("string").alias("blob"))


@query(f"""SELECT 'proc_heap' AS source, count(*) AS entries FROM part UNION ALL SELECT 'literals', count(*) FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT 'binary', count(*) FROM part WHERE NOT {BAD64}""")
def addr_union(spark, sf_dir):
    return heap_dump(spark, sf_dir).addresses.groupBy("source").agg(F.count("*").alias("entries"))


@query("SELECT lpad(lower(to_hex(160)), 16, '0') AS addr, true AS found, 'I' || p_size AS text FROM part WHERE p_partkey = 10 UNION ALL SELECT 'ffffffffffffffff', false, '(not found)'")
def addr_lookup(spark, sf_dir):
    d = heap_dump(spark, sf_dir)
    return d.lookup("0xA0").union(d.lookup("ffffffffffffffff"))


@query("SELECT page_id, strlen(html) AS bytes, md5(html) AS hash FROM pages")
def binary_decode(spark, sf_dir):
    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    d = dump(lines(p, k, F.array(text("=binary:", hexadecimal(k * 8 + 8)), text(hexadecimal(F.octet_length("html").cast("long")), ":", encoded(F.col("html"))))))
    return d.addresses.select((F.conv("addr", 16, 10).cast("long") / 8 - 1).cast("long").alias("page_id"), F.length("blob").cast("long").alias("bytes"), F.md5("blob").alias("hash"))


# terms


def decoded_lines(*parts: DataFrame) -> DataFrame:
    """Of =probe sections: the key and the rendered term of each line."""
    return dump(*parts).decoded("probe").select("key", "text")


def probe(df: DataFrame, key, *terms) -> DataFrame:
    """Terms stand behind a register, as an all-hex start such as A5 would be read as a label."""
    return lines(df, key, F.array(text("=probe:", key), *(text("y0:", t) for t in terms)))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, '{' || o_orderkey || ',''' || o_orderstatus || ''',<0.' || o_custkey || '.0>,[]}' AS text FROM orders")
def term_tuple_render(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return decoded_lines(probe(o, k, text("t4:I", k, ",", atom(F.col("o_orderstatus")), ",P<0.", F.col("o_custkey"), ".0>,N")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, '\"' || p_name || '\"' AS text FROM part")
def term_list_string(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    chars = F.transform(F.split("p_name", ""), lambda c: F.concat(F.lit("lI"), F.ascii(c).cast("string"), F.lit("|")))
    return decoded_lines(probe(p, k, text(F.array_join(chars, ""), "N")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, '#{' || lower(p_type_q) || ' => ' || p_size || ',price => <<\"' || p_brand || '\">>}' AS text FROM (SELECT *, 'size' AS p_type_q FROM part)")
def term_map_render(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    value = text("Yh", hexadecimal(F.octet_length("p_brand").cast("long")), ":", encoded(F.col("p_brand")))
    return decoded_lines(probe(p, k, text("Mf2:H", hexadecimal(k * 16 + 16), ":I", F.col("p_size"), ",", value)), lines(p, k, F.array(F.lit("=proc_heap:x"), text(hexadecimal(k * 16 + 16), ":t2:A4:size,A5:price")), 1))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, '#{1 => ' || n_nationkey || ',2 => ' || n_regionkey || ',3 => 4}' AS text FROM nation")
def term_hash_map(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    return decoded_lines(probe(n, k, text("Mh3:2:lI1|I", k, ",Mn2:lI2|I", F.col("n_regionkey"), ",lI3|I4")))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, '''' || n_name || '''' AS text FROM nation UNION ALL SELECT CAST(r_regionkey + 1000 AS VARCHAR), lower(r_name_q) FROM (SELECT *, replace(r_name, ' ', '_') AS r_name_q FROM region) UNION ALL SELECT '2000', '''if''' UNION ALL SELECT '2001', 'hello_World@1'")
def atom_quoting(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    one = spark.range(1)
    return decoded_lines(probe(n, F.col("n_nationkey"), atom(F.col("n_name"))), probe(r, F.col("r_regionkey") + 1000, atom(F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))))), probe(one, F.lit(2000), F.lit("A2:if")), probe(one, F.lit(2001), F.lit("Ad:hello_World@1")))


CHAIN = "SELECT l_orderkey, '[' || string_agg(CAST(l_partkey + 1000 AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) || ']' AS list FROM lineitem GROUP BY l_orderkey"


def chain_dump(spark: SparkSession, sf_dir: str, missing: bool = False) -> Dump:
    """Each order's parts as a list, one heap word a cell."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    k = F.col("l_orderkey")
    at = lambda i: F.lower(F.hex(k * (1 << 24) + i.cast("long") * 16 + 16))
    items = items.withColumn("items", F.when(F.size("items") < (1 << 20) - 1, F.col("items")).otherwise(F.raise_error(F.concat(F.lit("too many items for the addresses of order "), k.cast("string")))))
    last = F.when(F.lit(missing) & (k % 2 == 0), F.lit("Hdeadbeef")).otherwise("N")
    cells = F.transform("items", lambda x, i: F.concat(at(i), F.lit(":lI"), (x["l_partkey"] + 1000).cast("string"), F.lit("|"), F.when(i + 1 < F.size("items"), F.concat(F.lit("H"), at(i + 1))).otherwise(last)))
    return dump(lines(items, k, F.array(text("=probe:", k), text("y0:H", at(F.lit(0))))), lines(items, k, F.concat(F.array(text("=proc_heap:", k)), cells), 1))


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS key, list AS text FROM ({CHAIN})")
def pointer_chase(spark, sf_dir):
    return chain_dump(spark, sf_dir).materialized().decoded("probe").select("key", "text")


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS key, list AS text FROM ({CHAIN})")
def pointer_chase_joined(spark, sf_dir):
    from .sources.shared import ensure_checkpoints

    ensure_checkpoints(spark)
    d = chain_dump(spark, sf_dir).materialized()
    rows = heap.labelled(d.kind("probe")).withColumn("term", F.col("raw"))
    return heap.decode_joined(rows, d.addresses).select("key", F.col("term_text").alias("text"))


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS key, CASE WHEN l_orderkey % 2 = 0 THEN replace(list, ']', '|(dump_truncated)]') ELSE list END AS text FROM ({CHAIN})")
def missing_pointer(spark, sf_dir):
    return chain_dump(spark, sf_dir, missing=True).decoded("probe").select("key", "text")


@query("SELECT CAST(n AS VARCHAR) AS key, CAST(least(n, 128) AS BIGINT) AS elements, n > 128 AS cut FROM (SELECT unnest([127, 128, 129, 200]) AS n)")
def depth_limit(spark, sf_dir):
    sizes = spark.createDataFrame([(127,), (128,), (129,), (200,)], "n long")
    n = F.col("n")
    at = lambda i: F.lower(F.hex(n * 65536 + i.cast("long") * 16))
    cells = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.concat(at(i), F.lit(":lI1000|"), F.when(i < n, F.concat(F.lit("H"), at(i + 1))).otherwise("N")))
    d = dump(lines(sizes, n, F.array(text("=probe:", n), text("H", at(F.lit(1))))), lines(sizes, n, F.concat(F.array(text("=proc_heap:", n)), cells), 1))
    return d.decoded("probe").select("key", F.regexp_count("text", F.lit("1000")).cast("long").alias("elements"), F.col("text").endswith("|...depth limit...]").alias("cut"))


@query("SELECT CAST(page_id AS VARCHAR) AS key, '<<\"' || substr(url, 6, 10) || '\">>' AS text FROM pages UNION ALL SELECT 'none', '<<>>'")
def subbinary_slice(spark, sf_dir):
    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    code = encoded(F.col("url"))
    return decoded_lines(probe(p, k, text("Yc", hexadecimal(k * 8 + 8), ":5:a")), lines(p, k, F.array(text("=binary:", hexadecimal(k * 8 + 8)), text("0:", code)), 1), lines(spark.range(1), F.lit(0), F.array(F.lit("=probe:none"), F.lit("Ysffffff:0:10")), 2))


@query("SELECT CAST(event_id AS VARCHAR) AS key, '{' || (event_id % 256) || ',' || CASE WHEN event_type IN ('after', 'begin', 'end', 'try') THEN '''' || event_type || '''' ELSE event_type END || ',<<\"' || props || '\">>,[]}' AS text FROM (SELECT event_id, event_type, replace(props, '\"', '\\\"') AS props FROM events)")
def etf_decode(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    h = lambda n, width: F.lpad(F.hex(n.cast("long")), width, "0")
    raw = F.concat(F.lit("83680461"), h(k % 256, 2), F.lit("77"), h(F.octet_length("event_type"), 2), F.hex("event_type"), F.lit("6D"), h(F.octet_length("props"), 8), F.hex("props"), F.lit("6A"))
    code = encoded(F.unhex(raw))
    return decoded_lines(probe(e, k, text("E", hexadecimal(F.length(raw) / 2), ":", code)))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, 'tuple' AS kind, o_orderkey AS first, o_orderstatus AS second FROM orders")
def term_json_path(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    d = dump(lines(o, k, F.array(text("=proc_stack:", k), text("y0:t2:I", k, ",", atom(F.col("o_orderstatus"))))))
    out = d.stack().withColumn("v", F.parse_json("term_json"))
    return out.select(F.col("pid").alias("key"), F.variant_get("v", "$.t", "string").alias("kind"), F.variant_get("v", "$.elems[0].v", "long").alias("first"), F.variant_get("v", "$.elems[1].v", "string").alias("second"))


@query("SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS key, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.0' AS text FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity = floor(l_quantity)) QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1")
def float_render(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity = floor(l_quantity)").select("l_orderkey", "l_linenumber", "l_quantity").distinct()
    rows = rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.first("l_quantity").alias("q")).filter("n = 1")
    value = F.format_string("%.1fe0", F.col("q"))
    return decoded_lines(probe(rows, F.col("l_orderkey") * 10 + F.col("l_linenumber"), text("F", hexadecimal(F.length(value)), ":", value)))


@query("SELECT CAST(r_regionkey AS VARCHAR) AS key, 'A' || strlen(r_name) AS label, r_name AS raw FROM region")
def label_ambiguity(spark, sf_dir):
    r, k = table(spark, sf_dir, "region"), F.col("r_regionkey")
    d = dump(lines(r, k, F.array(text("=proc_stack:", k), text("A", F.octet_length("r_name"), ":", F.col("r_name")))))
    return d.stack().select(F.col("pid").alias("key"), "label", "raw")


# formatting


@query(f"SELECT o_orderkey, {bytes_sql('CAST(o_orderkey * o_orderkey AS BIGINT)')} AS size_text, CAST(o_orderkey * 8 AS BIGINT) AS bytes FROM orders")
def fmt_bytes(spark, sf_dir):
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", fmt.bytes_text(n * n).alias("size_text"), fmt.words_to_bytes(n).cast("long").alias("bytes"))


@query("SELECT doc_id, CASE WHEN length(text) <= 20 THEN text ELSE substr(text, 1, 19) || '…' END AS short, '' AS none FROM documents")
def truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fmt.truncated(F.col("text"), 20).alias("short"), fmt.truncated(F.col("text"), 0).alias("none"))


@query("SELECT page_id, url_encode(url) AS encoded FROM pages")
def url_encode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fmt.url_encoded(F.col("url")).alias("encoded"))


@query("SELECT '_meta' AS kind, 'incomplete' AS key, CAST(1 AS BIGINT) AS line_count, CAST(1 AS BIGINT) AS size_bytes UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), CAST(1 AS BIGINT), strlen(n_name) + 1 FROM nation")
def incomplete_flag(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    d = dump(lines(n, k, F.array(text("=nation:", k), F.col("n_name"))), end=False)
    return d.sections().select("kind", "key", "line_count", "size_bytes")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation WHERE n_nationkey < 20")
def dropped_lines(spark, sf_dir):
    """Lines before the first header, in sections of no kind and behind =end aren't there."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    one = spark.range(1)
    early = lines(one, F.lit(0), F.array(F.lit("stray"), F.lit("more")), 0)
    named = lines(n.filter("n_nationkey < 20"), k, F.array(text("=nation:", k), F.col("n_name")), 1)
    none = lines(n.filter("n_nationkey < 5"), k, F.array(F.lit("=:x"), F.col("n_name")), 2)
    late = lines(n.filter("n_nationkey >= 20"), k, F.array(F.lit("=end"), F.col("n_name")), 3)
    return dump(early, named, none, late).section_lines.select("key", "value")


# dumps in files


def dump_file(spark: SparkSession, values: DataFrame, codec: str | None = None) -> str:
    """One file of ordered lines in the shared folder, and its path."""
    folder = new_folder(spark, "dump")
    writer = values.select("value").coalesce(1).write
    (writer.option("compression", codec) if codec else writer).text(folder)
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return next(f.getPath().toString() for f in files if f.getPath().getName().startswith("part-"))


def stored_documents(spark: SparkSession, sf_dir: str) -> StoredDump:
    """The documents' dump as a gzip file, ingested and opened."""
    d = document_dump(spark, sf_dir)
    path = dump_file(spark, d.lines.orderBy("block", "seq"), "gzip")
    store = Catalog(spark, new_folder(spark, "catalog"))
    return store.open(store.ingest(path))


@query("SELECT 'customers' AS label, true AS known, true AS listed, count(*) AS processes, false AS incomplete FROM customer")
def catalog(spark, sf_dir):
    """A dump file written, ingested, found again by the first digits of its fingerprint, by its path without another ingest, and listed."""
    path = dump_file(spark, dump(process_lines(spark, sf_dir)).lines.orderBy("block", "seq"))
    store = Catalog(spark, new_folder(spark, "catalog"))
    dump_id = store.ingest(path, "customers")
    known = store.resolve(dump_id[:6]) == store.resolve(path) == dump_id
    d = store.open(dump_id)
    counted = d.kind("proc").groupBy("dump_id").agg(F.count_distinct("section_id").alias("processes"))
    return store.list().join(counted, "dump_id").join(d.overview(), "dump_id").select("label", F.lit(known).alias("known"), (F.col("size") > 0).alias("listed"), "processes", "incomplete")


@query(ORACLE_SQL["line_page"])
def stored_line_page(spark, sf_dir):
    d = stored_documents(spark, sf_dir)
    return d.paged_lines(d.kind("doc_en"), 3, 5).select(F.substring_index("key", ":", -1).cast("long").alias("doc_id"), "n", "total", "value")


@query(ORACLE_SQL["section_catalog"])
def stored_catalogue(spark, sf_dir):
    return stored_documents(spark, sf_dir).sections().select("kind", "key", "line_count", "size_bytes")


@query("SELECT lpad(lower(to_hex(p_partkey * 16)), 16, '0') AS addr, 'I' || p_size AS blob FROM part")
def stored_addresses(spark, sf_dir):
    path = dump_file(spark, heap_dump(spark, sf_dir).lines.orderBy("block", "seq"))
    store = Catalog(spark, new_folder(spark, "catalog"))
    return store.open(store.ingest(path)).addresses.filter("source = 'proc_heap'").select("addr", F.col("blob").cast("string").alias("blob"))


@query(f"SELECT line AS value, count(*) AS times FROM ({DOC_LINES}) WHERE lang = 'fr' GROUP BY line UNION ALL SELECT '=== doc_fr:k:' || doc_id || ' ===', 1 FROM documents WHERE lang = 'fr'")
def raw_content(spark, sf_dir):
    """Sections written out under their banners, read again."""
    path = new_folder(spark, "content")
    document_dump(spark, sf_dir).write_content(path, "doc_fr", all_keys=True, banners=True)
    return spark.read.option("lineSep", "\n").text(path).groupBy("value").agg(F.count("*").alias("times"))


@query(f"SELECT {PID} AS pid, CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS memory, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS name, '<0.' || (c_custkey + 1) || '.0>' AS link FROM customer")
def json_rows(spark, sf_dir):
    d = processes(spark, sf_dir)
    return d.as_json(d.processes()).select(F.parse_json("json").alias("v")).select(*(F.variant_get("v", f"$.{c}", t).alias(c) for c, t in (("pid", "string"), ("memory", "long"), ("name", "string"))), F.variant_get("v", "$.links[0]", "string").alias("link"))


@query("""SELECT page - 1 AS page, CAST(n AS BIGINT) AS rows, first AS first_text FROM (SELECT CAST(ceil(n / 2.0) AS BIGINT) AS page, count(*) AS n, arg_min('{key,' || o_orderkey || '}', n) AS first FROM
 (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)) GROUP BY 1)""")
def all_pages(spark, sf_dir):
    """A process's dictionary to its end, two lines at a time."""
    d = detail_dump(spark, sf_dir)
    pid_ = f"<0.{table(spark, sf_dir, 'orders').agg(F.min('o_custkey')).first()[0]}.0>"
    found = [(i, len(rows), rows[0].term_text) for i, rows in enumerate(d.pages("dictionary", pid_, 2))]
    return spark.createDataFrame(found, "page long, rows long, first_text string")


# fixed terms

#: Terms as dumps write them, and how they are shown.
TERM_FORMS = [
    ("nil", "N", "[]"), ("negative", "I-1", "-1"), ("atom", "A2:ok", "ok"), ("upper", "A5:Hello", "'Hello'"), ("no_name", "A0:", "''"), ("word", "A2:if", "'if'"), ("dash", "A7:my-atom", "'my-atom'"),
    ("half", "F3:0.5", "0.5"), ("large", "F4:1e22", "10000000000000000000000.0"), ("small", "F4:1e-7", "0.0000001"), ("minus", "F5:-2.25", "-2.25"), ("nan", "F3:nan", "nan"), ("exponent", "F6:1.5e+2", "150.0"),
    ("big", "B16#1F", "16#1F"), ("big_decimal", "B123456789012345678901", "123456789012345678901"), ("pid", "P<0.1.0>", "<0.1.0>"), ("port", "p<0.5>", "#Port<0.5>"), ("dist", "D12:anything", "#DistExternal"),
    ("string", "lI104|lI10|N", '"h\\n"'), ("quoted", "lI34|lI92|N", '"\\"\\\\"'), ("bell", "lI104|lI7|N", "[104,7]"), ("escape", "lI27|lI9|lI8|N", '"\\e\\t\\b"'), ("latin", "lI233|N", '"é"'), ("improper", "lI1|I2", "[1|2]"),
    ("tuple", "t2:A2:ok,I1", "{ok,1}"), ("binary", "Yh5:aGVsbG8=", '<<"hello">>'), ("bytes", "Yh3:AAH/", "<<0,1,255>>"), ("empty", "Yh0:", "<<>>"),
]


def external_forms() -> list[tuple[str, bytes, str]]:
    """Terms in the external format, tag by tag, and how they are shown."""
    from struct import pack

    def name(x: str) -> bytes:
        return pack(">BB", 119, len(x)) + x.encode()

    one, two, node = b"a\x01", b"a\x02", name("n@h")
    return [
        ("70", pack(">Bd", 70, 2.5), "2.5"), ("98", pack(">Bi", 98, -5), "-5"), ("99", b"c" + b"1.50000000000000000000e+01".ljust(31, b"\0"), "15.0"), ("100", pack(">BH", 100, 2) + b"ok", "ok"), ("115", pack(">BB", 115, 2) + b"no", "no"), ("118", pack(">BH", 118, 3) + "é_".encode(), "'é_'"),
        ("105", pack(">BI", 105, 2) + one + two, "{1,2}"), ("107", pack(">BH", 107, 3) + b"abc", '<<"abc">>'), ("77", pack(">BIB", 77, 2, 4) + b"\1\2", "<<1,2>>"), ("108", pack(">BI", 108, 2) + one + two + b"j", "[1,2]"), ("108i", pack(">BI", 108, 1) + one + two, "[1|2]"),
        ("110", pack(">BBB", 110, 9, 0) + (1 << 64).to_bytes(9, "little"), "16#10000000000000000"), ("111", pack(">BIB", 111, 1, 1) + b"\xff", "-16#FF"), ("116", pack(">BI", 116, 1) + one + two, "#{1 => 2}"),
        ("88", b"X" + node + pack(">III", 1, 2, 3), "<n@h.1.2.3>"), ("103", b"g" + node + pack(">IIB", 1, 2, 3), "<n@h.1.2.3>"), ("89", b"Y" + node + pack(">II", 5, 3), "#Port<n@h.5.3>"), ("102", b"f" + node + pack(">IB", 5, 3), "#Port<n@h.5.3>"),
        ("90", pack(">BH", 90, 2) + node + pack(">III", 3, 7, 8), "#Ref<3.7.8>"), ("114", pack(">BH", 114, 1) + node + pack(">BI", 3, 7), "#Ref<3.7>"), ("101", b"e" + node + pack(">IB", 9, 1), "#Ref<1.9>"), ("113", b"q" + name("m") + name("f") + two, "{m,f,2}"),
        ("117", pack(">BI", 117, 0) + b"X" + node + pack(">III", 1, 2, 3) + name("m") + one + two, "#Fun<m.1.2>"),
        ("112", b"p" + pack(">I", 4 + 25 + 3 + 4) + bytes(25) + name("m") + one + two, "#Fun<m.1.2>"),
    ]


def values_sql(rows: list[tuple[str, str]]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in rows) + ") AS t(key, text)"


def fixed_terms(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "i long, k string, t string")
    return dump(lines(df, F.col("i"), F.array(text("=probe:", F.col("k")), text("y0:", F.col("t"))))).decoded("probe").select("key", "text")


@query(values_sql([(k, x) for k, _, x in TERM_FORMS]))
def term_forms(spark, sf_dir):
    return fixed_terms(spark, [(k, t) for k, t, _ in TERM_FORMS])


@query(values_sql([(k, x) for k, _, x in external_forms()]))
def etf_forms(spark, sf_dir):
    import base64

    return fixed_terms(spark, [(k, f"E{len(raw) + 1:x}:{base64.b64encode(bytes([131]) + raw).decode()}") for k, raw, _ in external_forms()])


@query("""SELECT total, place, size, place > 0 AS has_prev, place + size < total AS has_next, greatest(0, place - size) AS prev_offset, place + size AS next_offset, CAST(ceil(total / size) AS BIGINT) AS total_pages, place // size AS page, least(place + 1, total) AS start, least(place + size, total) AS stop
 FROM (SELECT CAST(p_size AS BIGINT) AS total, CAST(p_partkey % 60 AS BIGINT) AS place, CAST(p_partkey % 9 + 1 AS BIGINT) AS size FROM part WHERE p_partkey <= 100)""")
def pager(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").filter(k <= 100).select(F.col("p_size").cast("long"), (k % 60).cast("long"), (k % 9 + 1).cast("long")).collect()
    pages = [(t, a, s, fmt.Pager(t, a, s)) for t, a, s in rows]
    found = [(t, a, s, p.has_prev, p.has_next, p.prev_offset, p.next_offset, p.total_pages, p.page, p.start, p.end) for t, a, s, p in pages]
    return spark.createDataFrame(found, "total long, place long, size long, has_prev boolean, has_next boolean, prev_offset long, next_offset long, total_pages long, page long, start long, stop long")
