"""WARC archives of pages, a two-level capture index over them, and reads through it."""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import _common as C
from panelspark.llm.tokens import sliced

_ENTRY = "surt string, page_id bigint, url string, digest string, record_type string, archive string, offset bigint, length bigint"
_BLOCK = "first_key string, last_key string, index_file string, offset bigint, length bigint, lines int"
_SPAN = 8 << 20  # bytes that one range read may join


def surt(url: Column) -> Column:
    """Sort key of a URL: reversed host, then path and query; scheme, port and fragment are left out. White space and
    control characters are percent-escaped here, before anything is sorted, as index lines are cut at them."""
    u = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), r"#[\s\S]*$", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    for code in (*range(0x21), 0x7F):
        key = F.replace(key, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return key


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder's full URI as Spark itself takes it, so that tasks, too, write where Spark's readers look: a bare path
    belongs to the default file system, and file:/x and file:///x are one folder."""
    fs, path = C.file_system(spark, folder)
    return fs.makeQualified(path).toString()


def _open(folder: str):
    """File system and path of a qualified folder, for tasks."""
    from pyarrow import fs

    scheme, _, rest = folder.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"s3:{rest}" if scheme == "s3a" else folder)


def _record_id(page, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def _record(page, url: str | None, payload: bytes, digest: str, keeper) -> bytes:
    """One record; a revisit keeps the HTTP head, with the payload's length, but not the payload."""
    revisit = keeper is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page, digest)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(keeper, digest)}", f"X-Refers-To-Page-ID: {keeper}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return headers, rest[:n]


def _gzip(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(folder: str, roll: int):
    """Writes each task's rows to archives of its own, one gzip member for each record. Names are new for each attempt:
    archives of attempts that failed are in no index."""

    def run(batches):
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            for b in sliced(batch, 512):
                rows = []
                for r in b.to_pylist():
                    if out is None or at >= roll:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    member = _gzip(_record(r["page_id"], r["url"], r["_payload"], r["digest"], r["keeper"]))
                    out.write(member)
                    rows.append((r["surt"], r["page_id"], r["url"], r["digest"], "response" if r["keeper"] is None else "revisit", name, at, len(member)))
                    at += len(member)
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["surt", "page_id", "url", "digest", "record_type", "archive", "offset", "length"])
        if out is not None:
            out.close()

    return run


def _index(folder: str, block: int):
    """Packs sorted entries into gzip blocks of `block` lines, one index file for each task. Where its blocks are goes
    into a sparse directory beside the file, and into the rows given."""

    def run(batches):
        fs, root = _open(folder)
        name, at, held, rows = f"{uuid.uuid4().hex}.cdxj.gz", 0, [], []
        out = None

        def close():
            nonlocal at, out
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            data = _gzip("".join(f"{k} {v}\n" for k, v in held).encode())
            out.write(data)
            rows.append((held[0][0], held[-1][0], name, at, len(data), len(held)))
            at += len(data)
            held.clear()

        for batch in batches:
            for r in batch.to_pylist():
                held.append((r.pop("surt"), json.dumps(r)))
                if len(held) == block:
                    close()
        if held:
            close()
        if out is not None:
            out.close()
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
            directory = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["first_key", "last_key", "index_file", "offset", "length", "lines"])
            with fs.open_output_stream(f"{root}/{name}.dir", compression=None) as f, pa.ipc.new_stream(f, directory.schema) as w:
                w.write_batch(directory)
            yield directory

    return run


def _entries_of(lines: list[list[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([json.loads(v) | {"surt": k} for k, v in lines], schema=_arrow(_ENTRY))


def _block(f, length: int, offset: int) -> list[list[str]]:
    """Lines of one index block, read by its range, as (key, entry)."""
    return [x.split(" ", 1) for x in zlib.decompress(f.read_at(length, offset), 31).decode().split("\n")[:-1]]


def _blocks(folder: str):
    """All entries of index blocks."""

    def run(batches):
        fs, root = _open(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with fs.open_input_file(f"{root}/{r['index_file']}") as f:
                    if lines := _block(f, r["length"], r["offset"]):
                        yield _entries_of(lines)

    return run


def _route(held):
    """For each key the index files that may have it, found by binary search in their sorted key ranges."""

    def run(batches):
        first, last, names = held.value
        for batch in batches:
            files, keys = [], []
            for key in batch.column("key").to_pylist():
                for k in range(bisect.bisect_left(last, key), bisect.bisect_right(first, key)):
                    files.append(names[k])
                    keys.append(key)
            yield pa.record_batch([pa.array(files, pa.string()), pa.array(keys, pa.string())], names=["index_file", "key"])

    return run


def _lookup(folder: str):
    """Entries of keys sorted by (index file, key): a binary search in the file's sparse directory leads to a block, one
    in the block's lines to the entries. A block is read once for neighbouring keys."""

    def run(batches):
        fs, root = _open(folder)
        name, f, at, keys, lines = None, None, -1, [], []
        for batch in batches:
            out = []
            for file, key in zip(batch.column("index_file").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if file != name:
                    if f is not None:
                        f.close()
                    name, at = file, -1
                    with fs.open_input_stream(f"{root}/{name}.dir", compression=None) as d, pa.ipc.open_stream(d) as s:
                        directory = s.read_all().to_pydict()
                    f = fs.open_input_file(f"{root}/{name}")
                for k in range(bisect.bisect_left(directory["last_key"], key), bisect.bisect_right(directory["first_key"], key)):
                    if k != at:
                        at, lines = k, _block(f, directory["length"][k], directory["offset"][k])
                        keys = [x[0] for x in lines]
                    out += lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
                    if len(out) >= 4096:
                        yield _entries_of(out)
                        out = []
            if out:
                yield _entries_of(out)
        if f is not None:
            f.close()

    return run


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])


_RESULT = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _records(folder: str, with_payload: bool):
    """Records of entries sorted by archive and offset. Neighbours are read in one range."""
    schema = _arrow(_RESULT + (", payload binary" if with_payload else ""))

    def parsed(entry: dict, member: bytes) -> dict:
        headers, block = parse_record(zlib.decompress(member, 31))
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
        if headers["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
        number = lambda k: int(headers[k]) if k in headers else None
        out = {"page_id": number("x-page-id"), "url": entry["url"], "payload_bytes": size, "payload_digest": digest, "record_type": headers["warc-type"], "refers_to": number("x-refers-to-page-id")}
        return out | ({"payload": payload if headers["warc-type"] == "response" else None} if with_payload else {})

    def run(batches):
        fs, root = _open(folder)
        name, f = None, None
        for batch in batches:
            rows, k = batch.to_pylist(), 0
            out = []
            while k < len(rows):
                j, first = k + 1, rows[k]
                while j < len(rows) and rows[j]["archive"] == first["archive"] and rows[j]["offset"] == rows[j - 1]["offset"] + rows[j - 1]["length"] and rows[j]["offset"] + rows[j]["length"] - first["offset"] <= _SPAN:
                    j += 1
                if first["archive"] != name:
                    if f is not None:
                        f.close()
                    name = first["archive"]
                    f = fs.open_input_file(f"{root}/{name}")
                span = f.read_at(rows[j - 1]["offset"] + rows[j - 1]["length"] - first["offset"], first["offset"])
                for r in rows[k:j]:
                    a = r["offset"] - first["offset"]
                    out.append(parsed(r, span[a : a + r["length"]]))
                    if with_payload and len(out) >= 512:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                k = j
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if f is not None:
            f.close()

    return run


@dataclass
class CaptureIndex:
    """Archives and index files in `folder`, and the sparse directory of index blocks as a table there."""

    spark: SparkSession
    folder: str

    def __post_init__(self):
        self.folder = qualified(self.spark, self.folder)

    def directory(self) -> DataFrame:
        return self.spark.read.schema(_BLOCK).parquet(f"{self.folder}/directory")

    def files(self) -> list[tuple[str, str, str]]:
        """(first key, last key, name) of the index files in order: one for each task that wrote some, so a small table."""
        ends = self.directory().groupBy("index_file").agg(F.min("first_key").alias("a"), F.max("last_key").alias("b"))
        return sorted((r.a, r.b, r.index_file) for r in ends.collect())

    def entries(self, urls: list[str] | DataFrame | None = None) -> DataFrame:
        """Index entries of all captures, or of those whose key is that of one of the URLs: a list, or a table with a column url.

        Keys go to the index files that may have them, by binary search in the files' key ranges; there they are sorted
        and found by binary search, first in the file's block directory and then in the block. The number of keys is free.
        """
        n = C.partitions(self.spark)
        if urls is None:
            return self.directory().repartition(n, "index_file", "offset").mapInArrow(_blocks(self.folder), _ENTRY)
        if isinstance(urls, list):
            urls = self.spark.createDataFrame([(u,) for u in urls], "url string")
        held = self.spark.sparkContext.broadcast(tuple(list(x) for x in zip(*self.files(), strict=True)) or ([], [], []))
        wanted = urls.select(surt(F.col("url")).alias("key")).distinct()
        routed = wanted.mapInArrow(_route(held), "index_file string, key string")
        return routed.repartition(n, "index_file").sortWithinPartitions("index_file", "key").mapInArrow(_lookup(self.folder), _ENTRY)

    def read(self, urls: list[str] | DataFrame | None = None, with_payload: bool = False) -> DataFrame:
        """Captures of all or of some URLs (see `entries`), read from the archives and checked against their digests."""
        n = C.partitions(self.spark)
        found = self.entries(urls).repartition(n, "archive").sortWithinPartitions("archive", "offset")
        return found.mapInArrow(_records(self.folder, with_payload), _RESULT + (", payload binary" if with_payload else ""))


def write_archives(pages: DataFrame, folder: str, least_revisit: int = 1000, block: int = 3000, roll: int = 64 << 20, id_col: str = "page_id", url: str = "url", html: str = "html") -> CaptureIndex:
    """Write a record for each page and the index over them; give the index.

    Of pages with equal payloads of at least least_revisit bytes the one with the largest id becomes the response, the
    others revisits of it; smaller payloads are always responses. Equal payloads are found by SHA-1 digests alone; only
    pages of such groups take part in the join back, in which texts are spread by id and digest, so that a payload of very many
    pages is no hot key. Index entries are range-partitioned by (reversed host and path, archive, offset).

    Defined results: null html is the empty payload; null URLs have an empty key; null ids: written as responses, or
    revisits if another id has the payload; rows equal in id and payload get equal records each (of the largest id,
    responses); an empty table gives an empty index; other columns of pages are not read.
    """
    spark = pages.sparkSession
    C.prepare(spark)
    folder = qualified(spark, folder)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("_payload"))
    rows = rows.withColumn("digest", F.sha1("_payload"))
    small = rows.where(F.length("_payload") >= least_revisit).select("page_id", "digest")
    keepers = C.materialise(small.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("keeper").isNotNull()).select("digest", "keeper"), "keepers")
    copies = small.join(keepers, "digest").where(~F.col("page_id").eqNullSafe(F.col("keeper"))).distinct()
    a, b = rows.alias("a"), copies.alias("b").hint("shuffle_hash")
    decided = a.join(b, F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.digest") == F.col("b.digest")), "left")
    decided = decided.select("a.page_id", "a.url", "a._payload", "a.digest", "b.keeper", surt(F.col("a.url")).alias("surt"))
    entries = C.materialise(decided.mapInArrow(_write(folder, roll), _ENTRY), "captures")
    ordered = entries.repartitionByRange(C.partitions(spark), "surt", "archive", "offset").sortWithinPartitions("surt", "archive", "offset")
    ordered.mapInArrow(_index(folder, block), _BLOCK).write.parquet(f"{folder}/directory")
    return CaptureIndex(spark, folder)
