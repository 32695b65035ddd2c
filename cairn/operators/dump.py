"""A dump's queries. Every method returns a DataFrame; rows carry dump_id, so a Dump may hold many dumps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import fmt, terms
from ..plans import sections as plan
from ..plans.ranking import ranked
from ..sources.shared import new_folder
from . import heap

#: The keys of process and ETS sections, with what they become.
PROCESS_TEXT = {"State": "state", "Name": "name", "Spawned as": "spawned_as", "Spawned by": "spawned_by", "Program counter": "program_counter"}
PROCESS_COUNTS = {"Message queue length": "mqueue_len", "Stack+heap": "stack_heap", "OldHeap": "old_heap", "Heap unused": "heap_unused", "Memory": "memory", "Reductions": "reductions"}
PROCESS_LISTS = {"Link list": "links", "Monitor list": "monitors"}
ETS_TEXT = {"Name": "name", "Type": "table_type", "Protection": "protection"}
ETS_COUNTS = {"Objects": "objects", "Words": "words"}
ETS_FLAGS = {"Write Concurrency": "write_concurrency", "Read Concurrency": "read_concurrency", "Compressed": "compressed", "Fixed": "fixed"}


SECTIONS = "dump_id string, section_id long, key string, line_no long, n long, is_header boolean, value string, kind string"


def key_values(lines: DataFrame) -> DataFrame:
    """Adds k and v of `Key: Value` lines, split at the first colon with a blank, the value trimmed; drops others."""
    at = F.instr("value", ": ")
    return lines.filter(at > 0).withColumn("k", F.substring("value", F.lit(1), at - 1)).withColumn("v", F.regexp_replace(F.substr("value", at + 2), r"^\s+|\s+$", ""))


def keyed(lines: DataFrame) -> DataFrame:
    """As key_values(), with k and v null for other lines, so that a section with none is still seen."""
    at = F.instr("value", ": ")
    return lines.withColumn("k", F.when(at > 0, F.substring("value", F.lit(1), at - 1))).withColumn("v", F.when(at > 0, F.regexp_replace(F.substr("value", at + 2), r"^\s+|\s+$", "")))


def _last(key: str) -> Column:
    """The value of the last line with a key."""
    return F.max_by("v", F.when(F.col("k") == key, F.col("line_no")))


def _count(text: Column) -> Column:
    """A counter as bigint where it fits, what can't be read as 0."""
    value = F.coalesce(fmt.unsigned(text), F.lit(0).cast("decimal(20,0)"))
    return F.least(value, F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long")


def _pids(text: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(F.trim(text), r"^\[+", ""), r"\]+$", "")
    parts = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


class Dump:
    #: Whether addresses are read from a table.
    stored = False

    def __init__(self, lines: DataFrame):
        """lines: as read_lines() or numbered() give them."""
        self.lines = lines

    @property
    def spark(self) -> SparkSession:
        return self.lines.sparkSession

    @cached_property
    def all_sections(self) -> DataFrame:
        return plan.section_lines(self.lines)

    @cached_property
    def section_lines(self) -> DataFrame:
        return self.all_sections.filter(~F.col("is_header")).drop("is_header")

    @cached_property
    def catalogue(self) -> DataFrame:
        """(dump_id, section_id, kind, key, line_count, size_bytes) of text sections."""
        return plan.catalogue(self.all_sections)

    @cached_property
    def addresses(self) -> DataFrame:
        return heap.store(heap.entries(self.all_sections))

    @cached_property
    def access(self) -> heap.Access:
        return heap.Access(self.addresses, table=self.stored)

    def materialized(self) -> Dump:
        """The same dump with its sections written to the shared folder by kind, for several queries over one."""
        path = new_folder(self.spark, "sections")
        self.all_sections.write.partitionBy("kind").parquet(path)
        out = Dump(self.lines)
        out.all_sections = self.spark.read.schema(SECTIONS).parquet(path)
        return out

    # sections

    def kind(self, *kinds: str) -> DataFrame:
        return self.section_lines.filter(F.col("kind").isin(*kinds))

    def sections(self, sort_by: str = "size") -> DataFrame:
        """The catalogue with rank: by size, largest first, by kind or by key."""
        order = {"kind": ["kind", "key"], "key": ["key", "kind"]}.get(sort_by, [F.desc("size_bytes"), "kind", "key"])
        return ranked(self.catalogue, *order, "section_id")

    def section_groups(self) -> DataFrame:
        return self.catalogue.groupBy("dump_id", "kind").agg(F.count("*").alias("entries"), F.sum("size_bytes").alias("total_bytes")).withColumn("rank", F.row_number().over(Window.partitionBy("dump_id").orderBy(F.desc("total_bytes"), "kind")).cast("long"))

    def has_section(self, kind: str, key: str | None = None) -> bool:
        return not self.catalogue.filter((F.col("kind") == kind) & F.col("key").eqNullSafe(F.lit(key))).isEmpty()

    def query(self, kind: str, key: str | None = None, all_keys: bool = False, banners: bool = False) -> DataFrame:
        """(section_id, kind, key, line_no, value) of one section, the first of several with its key, in order; or of all of a kind with all_keys. Without a key, the section without one. banners: with a column banner, to be shown before the lines of each section."""
        rows = self.kind(kind)
        if not all_keys:
            rows = rows.filter(F.col("key").eqNullSafe(F.lit(key)))
            first = rows.groupBy("dump_id").agg(F.min("section_id").alias("section_id"))
            rows = rows.join(first, ["dump_id", "section_id"])
        banner = F.concat(F.lit("=== "), F.concat_ws(":", "kind", "key"), F.lit(" ==="))
        return rows.select("dump_id", "section_id", "kind", "key", "line_no", "value", *([banner.alias("banner")] if banners else [])).orderBy("dump_id", F.col("key").asc_nulls_first(), "section_id", "line_no")

    def write_content(self, path: str, kind: str, key: str | None = None, all_keys: bool = False, banners: bool = False) -> None:
        """The lines of query() as text files whose names are in the order of their lines."""
        rows = self.query(kind, key, all_keys, banners)
        if banners:
            first = F.col("line_no") == F.min("line_no").over(Window.partitionBy("dump_id", "section_id"))
            rows = rows.withColumn("value", F.when(first, F.concat_ws("\n", "banner", "value")).otherwise(F.col("value"))).orderBy("dump_id", F.col("key").asc_nulls_first(), "section_id", "line_no")
        rows.select("value").write.text(path)

    def numbered_lines(self, rows: DataFrame) -> DataFrame:
        """Of lines with n, their place among those of their section that aren't empty, those that have one, with total."""
        kept = rows.filter("n is not null")
        return kept.join(kept.groupBy("dump_id", "section_id").agg(F.count("*").alias("total")), ["dump_id", "section_id"])

    def paged_lines(self, rows: DataFrame, offset: int | None, limit: int | None) -> DataFrame:
        """numbered_lines() of a page; lines are cut to it before anything else looks at them."""
        numbered = self.numbered_lines(rows)
        return numbered if offset is None else self.page(numbered, offset, limit)

    def line_page(self, kind: str, key: str | None, offset: int, limit: int) -> DataFrame:
        rows = self.kind(kind).filter(F.col("key").eqNullSafe(F.lit(key)))
        return self.paged_lines(rows, offset, limit).select("dump_id", "section_id", "n", "total", "value")

    def raw_process(self, pid: str) -> DataFrame:
        """The lines of a process's four sections under banners, those that there are."""
        kinds = ("proc", "proc_stack", "proc_dictionary", "proc_messages")
        rows = self.kind(*kinds).filter(F.col("key") == pid)
        return rows.select("dump_id", F.concat(F.lit("=== "), "kind", F.lit(":"), "key", F.lit(" ===")).alias("banner"), "section_id", "line_no", "value").orderBy("dump_id", "section_id", "line_no")

    # processes

    def processes(self, q: str = "", sort_by: str = "memory", top: int | None = None) -> DataFrame:
        """Summaries with rank: by memory, largest first, or by pid as text. q keeps those that hold it, in any case, in pid, name, spawned_as or state."""
        rows = keyed(self.kind("proc").filter("key is not null"))
        wanted = [_last(k).alias(c) for k, c in {**PROCESS_TEXT, **PROCESS_COUNTS, **PROCESS_LISTS, "arity": "arity"}.items()]
        found = rows.groupBy("dump_id", "section_id", F.col("key").alias("pid")).agg(*wanted)
        out = found.select("dump_id", "section_id", "pid", "name", F.coalesce("state", F.lit("")).alias("state"), "spawned_as", "spawned_by", *(_count(F.col(c)).alias(c) for c in PROCESS_COUNTS.values()), "program_counter", F.least(_count(F.col("arity")), F.lit((1 << 31) - 1)).cast("int").alias("arity"), *(_pids(F.col(c)).alias(c) for c in PROCESS_LISTS.values()))
        if q:
            wanted_text = F.lower(F.lit(q))
            hit = F.lit(False)
            for c in ("pid", "name", "spawned_as", "state"):
                hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), wanted_text)
            out = out.filter(hit)
        order = ["pid", "section_id"] if sort_by == "pid" else [F.desc("memory"), "pid", "section_id"]
        return ranked(out, *order, top=top)

    def display(self, processes: DataFrame) -> DataFrame:
        """Adds display_name, short_name and the sizes as text."""
        name = F.coalesce("name", "spawned_as")
        return processes.withColumn("display_name", name).withColumn("short_name", fmt.short_name(F.coalesce(name, F.lit("-")))).withColumn("memory_text", fmt.bytes_text(F.col("memory"))).withColumn("stack_heap_bytes", fmt.words_to_bytes(F.col("stack_heap"))).withColumn("stack_heap_text", fmt.words_text(F.col("stack_heap")))

    def stack(self, rows: DataFrame | None = None, offset: int | None = None, limit: int | None = None) -> DataFrame:
        """(dump_id, pid, section_id, n, total, label, raw, term_text, term_json) of all stack lines, of those given, or of a page of each section."""
        rows = self.kind("proc_stack") if rows is None else rows
        rows = heap.labelled(self.paged_lines(rows, offset, limit)).withColumnRenamed("key", "pid")
        rows = rows.withColumn("term", F.when(F.col("raw").rlike(heap.tagged(terms.STACK_TAGS)), F.col("raw")))
        return heap.decode(rows.select("dump_id", "pid", "section_id", "n", "total", "label", "raw", "term"), self.access).drop("term", "term_error")

    def term_lines(self, kind: str, rows: DataFrame | None = None, compat: bool = True, offset: int | None = None, limit: int | None = None) -> DataFrame:
        """(dump_id, pid, section_id, n, total, term_text, term_json) of dictionary or message lines; n counts raw lines, and what can't be decoded is left out."""
        rows = self.kind(kind) if rows is None else rows
        rows = heap.labelled(self.paged_lines(rows, offset, limit)).withColumnRenamed("key", "pid")
        term = F.when(F.col("value").startswith("H"), F.col("value")).otherwise(F.col("raw"))
        rows = rows.withColumn("term", term)
        if not compat:
            whole = heap.decode(rows.withColumn("term", F.when(F.col("label") != "", F.col("value"))), self.access)
            own = F.col("term_text").isNotNull()
            rows = whole.withColumn("term", F.when(own, F.col("value")).otherwise(term)).drop("term_text", "term_json", "term_error")
        out = heap.decode(rows.select("dump_id", "pid", "section_id", "n", "total", "term"), self.access)
        return out.filter("term_text is not null").drop("term", "term_error")

    def page(self, rows: DataFrame, offset: int, limit: int) -> DataFrame:
        """Of stack() or term_lines(): a page by raw lines."""
        return rows.filter((F.col("n") >= offset) & (F.col("n") < offset + limit))

    def stack_page(self, pid: str, offset: int, limit: int) -> DataFrame:
        return self.stack(self.kind("proc_stack").filter(F.col("key") == pid), offset, limit)

    def dictionary_page(self, pid: str, offset: int, limit: int) -> DataFrame:
        return self.term_lines("proc_dictionary", self.kind("proc_dictionary").filter(F.col("key") == pid), offset=offset, limit=limit)

    def messages_page(self, pid: str, offset: int, limit: int) -> DataFrame:
        return self.term_lines("proc_messages", self.kind("proc_messages").filter(F.col("key") == pid), offset=offset, limit=limit)

    def pages(self, what: str, pid: str, size: int = 1000) -> Iterator[list]:
        """All pages of a process's `stack`, `dictionary` or `messages`, as lists of rows, one at a time. Pages go by raw lines, so one of lines that can't be decoded is empty."""
        kind = "proc_" + what
        rows = self.kind(kind).filter((F.col("key") == pid) & F.col("n").isNotNull())
        total = rows.agg(F.max("n")).first()[0]
        for offset in range(0, 0 if total is None else total + 1, max(1, size)):
            yield getattr(self, what + "_page")(pid, offset, size).orderBy("dump_id", "section_id", "n").collect()

    @staticmethod
    def shortened(rows: DataFrame, length: int) -> DataFrame:
        """Rows of terms, their text cut to so many characters."""
        return rows.withColumn("term_text", fmt.truncated(F.col("term_text"), length))

    @staticmethod
    def as_json(rows: DataFrame) -> DataFrame:
        """(json): each row as an object, nulls included; term_json as the object that it is."""
        text = F.to_json(F.struct(*(c for c in rows.columns if c != "term_json")), {"ignoreNullFields": "false"})
        if "term_json" not in rows.columns:
            return rows.select(text.alias("json"))
        return rows.select(F.concat(F.substr(text, F.lit(1), F.length(text) - 1), F.lit(',"term":'), F.coalesce("term_json", F.lit("null")), F.lit("}")).alias("json"))

    def details(self, pid: str | None = None) -> DataFrame:
        """Summaries with arrays stack, dictionary and messages, in order, empty where a process has none."""
        def only(kind: str) -> DataFrame:
            rows = self.kind(kind)
            return rows if pid is None else rows.filter(F.col("key") == pid)

        def listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
            each = rows.groupBy("dump_id", "pid", "section_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", *columns))), lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias(name))
            return each.groupBy("dump_id", "pid").agg(F.min_by(name, "section_id").alias(name))

        out = self.processes()
        out = out if pid is None else out.filter(F.col("pid") == pid)
        children = [listed(self.stack(only("proc_stack")), "stack", "label", "term_text", "raw"), listed(self.term_lines("proc_dictionary", only("proc_dictionary")), "dictionary", "term_text", "term_json"), listed(self.term_lines("proc_messages", only("proc_messages")), "messages", "term_text", "term_json")]
        for child, name in zip(children, ("stack", "dictionary", "messages")):
            out = out.join(child, ["dump_id", "pid"], "left").withColumn(name, F.coalesce(name, F.array().cast(child.schema[name].dataType)))
        return out

    def decoded(self, kind: str, key: str | None = None) -> DataFrame:
        """(section_id, key, line_no, text): a section line by line, terms rendered, errors said, other lines as they are."""
        rows = self.kind(kind) if key is None else self.kind(kind).filter(F.col("key") == key)
        rows = heap.labelled(rows)
        rows = rows.withColumn("term", F.when(F.col("raw").rlike(heap.tagged(terms.DECODE_TAGS)), F.col("raw")))
        out = heap.decode(rows, self.access)
        error = F.concat(F.lit("# parse error: "), "term_error", F.lit("  (raw: "), "raw", F.lit(")"))
        text = F.when(F.col("raw") == "", F.lit("")).when(F.col("term").isNull(), F.col("value")).otherwise(F.coalesce("term_text", error))
        return out.select("dump_id", "section_id", "key", "line_no", text.alias("text"))

    # memory and tables

    def memory(self) -> DataFrame:
        """(dump_id, ord, key, bytes): the entries of =memory in order, those without a number left out."""
        rows = key_values(self.kind("memory").filter("key is null")).withColumn("bytes", fmt.unsigned(F.col("v"))).filter("bytes is not null")
        first = rows.groupBy("dump_id").agg(F.min("section_id").alias("section_id"))
        rows = rows.join(first, ["dump_id", "section_id"])
        return rows.select("dump_id", F.row_number().over(Window.partitionBy("dump_id").orderBy("line_no")).cast("long").alias("ord"), F.col("k").alias("key"), F.least("bytes", F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long").alias("bytes"))

    def memory_total(self, last: bool = False) -> DataFrame:
        """(dump_id, total): the first entry of that name, or the last one; 0 without one."""
        of = F.when(F.col("key") == "total", F.col("ord"))
        return self.memory().groupBy("dump_id").agg(F.coalesce((F.max_by if last else F.min_by)("bytes", of), F.lit(0)).alias("total"))

    def memory_map(self) -> DataFrame:
        """(dump_id, key, bytes): of equal names the last one."""
        return self.memory().groupBy("dump_id", "key").agg(F.max_by("bytes", "ord").alias("bytes"))

    def ets(self) -> DataFrame:
        """One row a table, several of one owner kept apart, with rank by words."""
        rows = keyed(self.kind("ets"))
        wanted = [_last(k).alias(c) for k, c in {**ETS_TEXT, **ETS_COUNTS, "Buckets": "buckets", **ETS_FLAGS}.items()]
        found = rows.groupBy("dump_id", "section_id", F.coalesce("key", F.lit("")).alias("owner_pid")).agg(*wanted)
        buckets = fmt.unsigned(F.col("buckets"))
        out = found.select("dump_id", "section_id", "owner_pid", *(F.coalesce(c, F.lit("")).alias(c) for c in ETS_TEXT.values()), *(_count(F.col(c)).alias(c) for c in ETS_COUNTS.values()), buckets.cast("long").alias("buckets"), *(F.coalesce(F.col(c) == "true", F.lit(False)).alias(c) for c in ETS_FLAGS.values()))
        out = ranked(out, F.desc("words"), "name", "owner_pid", "section_id")
        switches = {c: F.col(c) for c in ETS_FLAGS.values()}
        return out.withColumn("flags", fmt.flags(switches)).withColumn("flag_letters", fmt.flags(switches, letters=True)).withColumn("memory_bytes", fmt.words_to_bytes(F.col("words"))).withColumn("memory_text", fmt.words_text(F.col("words"), short=True))

    # addresses and figures

    def lookup(self, addr: str) -> DataFrame:
        return heap.lookup(self.addresses, addr)

    def stats(self) -> DataFrame:
        """Entries by source, text sections (empty ones too), repeats of addresses, and whether =end is missing; as text too."""
        found = heap.entries(self.all_sections).groupBy("dump_id").agg(*(F.count_if(F.col("source") == s).alias(c) for s, c in (("proc_heap", "heap_entries"), ("binary", "binary_entries"), ("literals", "literal_entries"))), (F.count("*") - F.count_distinct("addr")).alias("duplicates"))
        heads = self.all_sections.filter("is_header").groupBy("dump_id").agg(F.count_if(~F.col("kind").isin("end", *plan.ADDRESS_KINDS)).alias("text_sections"), (~F.bool_or(F.col("kind") == "end")).alias("incomplete"))
        out = heads.join(found, "dump_id", "left").fillna(0)
        line = F.format_string("heap=%d binaries=%d literals=%d text_sections=%d", "heap_entries", "binary_entries", "literal_entries", "text_sections")
        return out.withColumn("text", F.concat(line, F.when(F.col("incomplete"), " [INCOMPLETE — no =end marker]").otherwise("")))

    def overview(self) -> DataFrame:
        """(dump_id, total, processes_bytes, code, ets, process_count, incomplete): the cards of a dump, first entries of their names, 0 without one."""
        entry = lambda name: F.coalesce(F.min_by("bytes", F.when(F.col("key") == name, F.col("ord"))), F.lit(0))
        ids = self.all_sections.groupBy("dump_id").agg((~F.bool_or(F.col("kind") == "end")).alias("incomplete"))
        memory = self.memory().groupBy("dump_id").agg(entry("total").alias("total"), entry("processes").alias("processes_bytes"), entry("code").alias("code"), entry("ets").alias("ets"))
        count = self.kind("proc").filter("key is not null").groupBy("dump_id").agg(F.count_distinct("section_id").alias("process_count"))
        return ids.join(memory, "dump_id", "left").join(count, "dump_id", "left").fillna(0)
