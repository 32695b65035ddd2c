"""The address store, and decoding of terms that point into it."""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..functions import fmt, terms
from ..sources.shared import file_system, new_folder, written

#: A store of so many bytes at most is sent to every worker; a larger one is joined.
BROADCAST_BYTES = 64 << 20
#: A block of a larger store holds about so many bytes or entries; a worker keeps blocks of so many bytes at most, or one.
BLOCK_BYTES, BLOCK_ENTRIES, HELD_BYTES = 8 << 20, 100_000, 64 << 20
BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
TERM_JSON_BYTES = 200 * 1024


def entries(sections: DataFrame) -> DataFrame:
    """(dump_id, addr, source, line_no, blob) of all heap words, literals and binaries in file order, repeats included; lines without an address or with bad base64 are left out."""
    rows = sections.filter(~F.col("is_header"))
    line = F.ltrim(F.regexp_replace("value", r"^\s+", ""))
    colon = F.instr(line, ":")
    words = rows.filter(F.col("kind").isin("proc_heap", "literals") & (line != "") & (colon > 0)).select("dump_id", fmt.address(F.substring(line, F.lit(1), colon - 1)).alias("addr"), F.col("kind").alias("source"), "line_no", F.substr(line, colon + 1).cast("binary").alias("blob"))
    first = Window.partitionBy("dump_id", "section_id").orderBy("line_no")
    one = rows.filter("kind = 'binary'").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    code = F.trim(F.regexp_replace(F.substr("value", F.instr("value", ":") + 1), r"^\s+|\s+$", ""))
    blob = F.when(code.rlike(BASE64), F.try_to_binary(code, F.lit("base64")))
    binaries = one.select("dump_id", fmt.address(F.col("key")).alias("addr"), F.col("kind").alias("source"), "line_no", F.when(F.regexp_replace(F.base64(blob), r"\s", "") == code, blob).alias("blob"))
    return words.union(binaries).filter("addr is not null and blob is not null")


def store(found: DataFrame) -> DataFrame:
    """One entry an address, the first in file order."""
    first = Window.partitionBy("dump_id", "addr").orderBy("line_no")
    return found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def write_store(addresses: DataFrame, path: str) -> None:
    """In order of addresses, so that a lookup reads one row group."""
    addresses.repartitionByRange("dump_id", "addr").sortWithinPartitions("dump_id", "addr").write.option("compression", "zstd").parquet(path)


def lookup(addresses: DataFrame, addr: str) -> DataFrame:
    """(addr, found, text): the entry at a hex address, with or without 0x; bytes that are no text as a list."""
    wanted = f"{int(addr.removeprefix('0x'), 16):016x}"
    hit = addresses.filter(F.col("addr") == wanted).select("blob")
    text = F.when(F.is_valid_utf8("blob"), F.col("blob").cast("string")).otherwise(fmt.byte_list(F.col("blob")))
    return hit.agg(F.first("blob").alias("blob")).select(F.lit(wanted).alias("addr"), F.col("blob").isNotNull().alias("found"), F.coalesce(text, F.lit("(not found)")).alias("text"))


def _rendered(text: str, heap: terms.Heap) -> tuple[str | None, str | None, str | None]:
    try:
        term, _ = terms.parse(text, heap)
    except (terms.TermError, RecursionError) as e:
        return None, None, str(e)
    out = terms.json_text(term)
    return terms.render(term), out if len(out.encode()) <= TERM_JSON_BYTES else None, None


FIELDS = [StructField(n, StringType()) for n in ("term_text", "term_json", "term_error")]


def _with(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([x[i] for x in found], pa.string()) for i in range(3)]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *(f.name for f in FIELDS)])


class Access:
    """How decoding reaches a store: sent to every worker if it is no larger than limit, else by joins."""

    def __init__(self, addresses: DataFrame, limit: int = BROADCAST_BYTES, table: bool = False):
        """table: addresses are read from a table; else they are written as one first, so that what makes them runs once."""
        if not table:
            addresses = written(addresses.select("dump_id", "addr", "blob"), "addresses")
        self.addresses, self.limit = addresses, limit
        self.sent = None
        size = addresses.agg(F.coalesce(F.sum(F.length("blob") + 80), F.lit(0))).first()[0]
        if size <= limit:
            by: dict[str, dict[str, bytes]] = {}
            for row in addresses.select("dump_id", "addr", "blob").toLocalIterator():
                by.setdefault(row.dump_id, {})[row.addr] = bytes(row.blob)
            self.sent = addresses.sparkSession.sparkContext.broadcast(by)

    @cached_property
    def blocks(self) -> Blocks:
        return blocks(self.addresses)


def decode(lines: DataFrame, access: Access) -> DataFrame:
    """Adds term_text, term_json (null beyond TERM_JSON_BYTES) and term_error for the term that `term` begins with; null `term` gives nulls. Lines must have dump_id."""
    if access.sent is None:
        return decode_joined(lines, access.addresses, access.blocks)
    sent = access.sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = sent.value
        for batch in batches:
            rows = zip(batch.column("dump_id").to_pylist(), batch.column("term").to_pylist())
            yield _with(batch, [(None,) * 3 if t is None else _rendered(t, heaps.get(d, {}).get) for d, t in rows])

    return lines.mapInArrow(run, StructType([*lines.schema.fields, *FIELDS]))


def bucketed(addresses: DataFrame) -> tuple[DataFrame, str]:
    """The store as a table dealt to buckets by address once, so that joins with it move only the other side; and its name."""
    spark = addresses.sparkSession
    path = new_folder(spark, "store")
    name = "store_" + path.rpartition("-")[2]
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    addresses.select("dump_id", "addr", "blob").repartition(buckets, "dump_id", "addr").write.option("path", path).bucketBy(buckets, "dump_id", "addr").sortBy("dump_id", "addr").saveAsTable(name)
    return spark.table(name).hint("merge"), name


class Blocks:
    """A store in files, in order of addresses; for each, the (dump_id, addr) that it begins with."""

    def __init__(self, starts: list[tuple[str, str]], paths: list[str]):
        self.starts, self.paths = starts, paths


class Entries:
    """The entries of one dump in a block, found by address; a blob is made when it is asked for."""

    def __init__(self, addrs: pa.Array, blobs: pa.Array):
        _, digits = self.parts(addrs)
        nibbles = _NIBBLES[digits].reshape(-1, 8, 2)
        numbers = (nibbles[:, :, 0] << 4 | nibbles[:, :, 1]).reshape(-1).view(">u8")
        self.at = dict(zip(numbers.tolist(), range(len(numbers))))
        offsets, data = self.parts(blobs)
        self.offsets, self.data = offsets.tolist(), data.tobytes()

    @staticmethod
    def parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets from 0, and bytes."""
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
        return offsets - offsets[0], data

    def get(self, addr: str) -> bytes | None:
        i = self.at.get(int(addr, 16))
        return None if i is None else self.data[self.offsets[i] : self.offsets[i + 1]]


class Reader:
    """Blocks as a task reads them: those used last are kept."""

    def __init__(self, of: Blocks):
        self.starts, self.paths = of.starts, of.paths
        self.held: OrderedDict[int, tuple[int, dict[str, Entries]]] = OrderedDict()
        self.size = 0

    def place(self, dump_id: str, addr: str) -> int:
        """The block that has an address if any has it."""
        return max(0, bisect_right(self.starts, (dump_id, addr)) - 1)

    def entries(self, block: int, dump_id: str) -> Entries | None:
        if not self.paths:
            return None
        if block in self.held:
            self.held.move_to_end(block)
        else:
            fs, at = file_system(self.paths[block])
            with fs.open_input_file(at) as source:
                found = pq.read_table(source)
            while self.held and self.size + found.nbytes > HELD_BYTES:
                self.size -= self.held.popitem(last=False)[1][0]
            addrs, blobs = (found[c].cast(pa.large_binary()).combine_chunks() for c in ("addr", "blob"))
            by, row = {}, 0
            for x in found["dump_id"].value_counts().to_pylist():
                by[x["values"]] = Entries(addrs.slice(row, x["counts"]), blobs.slice(row, x["counts"]))
                row += x["counts"]
            self.held[block] = (found.nbytes, by)
            self.size += found.nbytes
        return self.held[block][1].get(dump_id)


def blocks(addresses: DataFrame) -> Blocks:
    """A store dealt to ranges of addresses and written to the shared folder block by block, once; the driver gets one row a block."""
    folder = new_folder(addresses.sparkSession, "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def put() -> pa.RecordBatch:
            name = f"{folder}/{uuid.uuid4().hex}.parquet"
            fs, at = file_system(name)
            fs.create_dir(at.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(at, compression=None) as out:
                pq.write_table(pa.Table.from_batches(held), out, compression="zstd")
            first = [held[0].column(c)[0].as_py() for c in ("dump_id", "addr")]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (*first, name)], names=["dump_id", "addr", "path"])

        size = rows = 0
        for batch in batches:
            step = max(1, min(BLOCK_ENTRIES, batch.num_rows * BLOCK_BYTES // max(1, batch.nbytes)))
            for piece in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                if held and (size + piece.nbytes > BLOCK_BYTES or rows + piece.num_rows > BLOCK_ENTRIES):
                    yield put()
                    held, size, rows = [], 0, 0
                held, size, rows = [*held, piece], size + piece.nbytes, rows + piece.num_rows
        if held:
            yield put()

    dealt = addresses.select("dump_id", "addr", "blob").repartitionByRange("dump_id", "addr").sortWithinPartitions("dump_id", "addr")
    found = sorted(map(tuple, dealt.mapInArrow(run, "dump_id string, addr string, path string").collect()))
    return Blocks([x[:2] for x in found], [x[2] for x in found])


_POINTERS = r"(?:H|Y[cs])([0-9A-Fa-f]+)"
_POINTER = re.compile(_POINTERS.encode())
_NIBBLES = np.array([int(chr(i), 16) if chr(i) in "0123456789abcdef" else 0 for i in range(256)], np.uint8)
_REACHED = "_line long, dump_id string, addr string, depth int, block int, blob binary"


class Outside(Exception):
    """A pointer leaves the block at hand."""


def _pointers(text: bytes) -> set[str]:
    """The addresses that a term may point to, those of what looks like a pointer within a string included."""
    return {terms.address(to) for x in _POINTER.findall(text) if not (to := int(x, 16)) >> 64}


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of _REACHED in batches of bounded size."""
    types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary())
    names = [x.split()[0] for x in _REACHED.split(", ")]
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 80 + len(row[5] or b"")
        if size >= 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names=names)


def _reached(rows: Iterator[tuple], reader: Reader) -> Iterator[tuple]:
    """For rows (line, dump, addr, depth, block) of _REACHED, those of a line and block together: the entries of the block that are reached, and without a blob the addresses ahead in others, each at its least depth."""
    for (line, dump_id, block), group in groupby(rows, lambda x: (x[0], x[1], x[4])):
        own = reader.entries(block, dump_id)
        queue, met = [(x[3], x[2]) for x in group], set()
        heapify(queue)
        while queue:
            depth, addr = heappop(queue)
            if addr in met:
                continue
            met.add(addr)
            blob = own and own.get(addr)
            if blob is None:
                if (place := reader.place(dump_id, addr)) != block:
                    yield line, dump_id, addr, depth, place, None
                continue
            yield line, dump_id, addr, depth, block, blob
            if depth <= terms.MAX_HOPS:
                for to in _pointers(blob) - met:
                    heappush(queue, (depth + 1, to))


def _gathered(lines: DataFrame, sent) -> DataFrame:
    """(_line, _heap): the entries that each line reaches. A round follows pointers to the ends of the blocks that it is in; only the frontier moves."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        rows = (x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("_line", "dump_id", "term"))))
        yield from _batches((line, d, to, 1, reader.place(d, to), None) for line, d, text in rows for to in _pointers(text.encode()))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns)))
        yield from _batches(_reached(rows, Reader(sent.value)))

    frontier = lines.select("_line", "dump_id", "term").mapInArrow(begin, _REACHED)
    seen = None
    for _ in range(terms.MAX_HOPS + 1):
        dealt = frontier.repartitionByRange("block", "_line").sortWithinPartitions("block", "_line")
        met = written(dealt.mapInArrow(follow, _REACHED), "met")
        seen = met if seen is None else seen.union(met)
        ahead = met.filter("blob is null").groupBy("_line", "dump_id", "addr", "block").agg(F.min("depth").alias("depth"))
        known = seen.filter("blob is not null").groupBy("_line", "addr").agg(F.min("depth").alias("known"))
        ahead = ahead.join(known, ["_line", "addr"], "left").filter("known is null or depth < known")
        frontier = written(ahead.select("_line", "dump_id", "addr", "depth", "block", F.lit(None).cast("binary").alias("blob")), "frontier")
        if frontier.isEmpty():
            break
    return seen.filter("blob is not null").groupBy("_line").agg(F.collect_list(F.struct("addr", "blob")).alias("_heap"))


def decode_joined(lines: DataFrame, addresses: DataFrame, store: Blocks | None = None) -> DataFrame:
    """As decode(), for a heap of any size: lines go to the block of the store that their first pointer is in, and are decoded there if nothing that they reach is elsewhere. What the others reach is gathered in rounds, from block to block, and goes to the task that decodes the line.

    Lines are dealt by ranges of that pointer and then of a hash of all columns, so that many lines with one pointer are spread. Rounds end when no line reaches anything new, after MAX_HOPS at the latest."""
    sent = lines.sparkSession.sparkContext.broadcast(store or blocks(addresses))
    columns = lines.columns

    def here(reader: Reader, dump_id: str, first: str | None) -> Callable[[str], bytes | None]:
        block = None if first is None else reader.place(dump_id, first)
        own = None if first is None else reader.entries(block, dump_id)

        def get(addr: str) -> bytes | None:
            blob = own and own.get(addr)
            if blob is None and reader.place(dump_id, addr) != block:
                raise Outside
            return blob

        return get

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for batch in batches:
            found, far = [], []
            for dump_id, text, first in zip(*(batch.column(c).to_pylist() for c in ("dump_id", "term", "_first"))):
                try:
                    found.append((None,) * 3 if text is None else _rendered(text, here(reader, dump_id, first)))
                    far.append(False)
                except Outside:
                    found.append((None,) * 3)
                    far.append(True)
            out = _with(batch, found)
            yield out.append_column("_far", pa.array(far, pa.bool_()))

    first = fmt.address(F.nullif(F.regexp_extract("term", _POINTERS, 1), F.lit("")))
    dealt = lines.withColumn("_first", first).withColumn("_salt", F.xxhash64(*columns)).repartitionByRange("dump_id", "_first", "_salt").sortWithinPartitions("dump_id", "_first")
    tried = dealt.mapInArrow(near, StructType([*dealt.schema.fields, *FIELDS, StructField("_far", BooleanType())])).withColumn("_line", F.monotonically_increasing_id())
    tried = written(tried, "decoded")
    wanted = [*columns, *(f.name for f in FIELDS)]
    done, far = tried.filter("not _far").select(*wanted), tried.filter("_far").select("_line", *columns)
    if far.isEmpty():
        return done
    joined = far.join(_gathered(far, sent), "_line", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, heap in zip(batch.column("term").to_pylist(), batch.column("_heap").to_pylist()):
                own = {x["addr"]: x["blob"] for x in heap or ()}
                found.append(_rendered(text, own.get))
            yield _with(batch, found)

    return done.union(joined.mapInArrow(run, StructType([*joined.schema.fields, *FIELDS])).select(*wanted))


def labelled(lines: DataFrame) -> DataFrame:
    """Adds label and raw, the line without it, for stack lines: a register or address before the first colon."""
    prefix = F.substring_index("value", ":", 1)
    has = F.col("value").contains(":") & prefix.rlike(r"^([xy][0-9]*|0x.*|[0-9A-Fa-f]*)$")
    return lines.withColumn("label", F.when(has, prefix).otherwise("")).withColumn("raw", F.when(has, F.substr("value", F.instr("value", ":") + 1)).otherwise(F.col("value")))


def tagged(tags: frozenset) -> str:
    return "^[" + re.escape("".join(sorted(tags))) + "]"
