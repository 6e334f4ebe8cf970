"""WARC archives with identical-payload revisits and a two-level capture index.

Writing: each task writes its rows as records, one gzip member each, to files in the shared folder. Of
equal payloads of at least ``least`` bytes one is a response and the others are revisits that point to it.
Tasks may run twice: a file belongs to the archive only if the written manifest names it.

Index: captures are sorted by reversed-host URL, page id and payload digest, cut by range into parts, and each part is a
file of compressed blocks with a sparse directory of the blocks' first keys. A lookup finds the part among
the parts' bounds (one row a part), binary-searches that part's directory, range-reads one block,
binary-searches its lines, and range-reads the record. Every payload that is read is compared with the digest in its header; a difference ends the job.

A null html is an empty payload, a null url has the address urn:page:ID, a null page_id is kept as null. Rows that
repeat page id and payload are alike: both are responses or both revisits. Rows that repeat page id and url but not the payload are captures of their own. A very long payload is written and read whole. Line ends and tabs in a url
are escaped. Only page_id, url and html are read, so other columns may have any name. An empty table makes an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, materialize, may_be_in, new_folder, salted_lookup

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "page_id long, capture_key string, url string, record_type string, payload_digest string, file string, offset long, length long"
PARTS = "path string, first_key string, last_key string, blocks long, captures long"
RECORDS = "page_id long, url string, record_type string, refers_key string, payload binary"
FOUND = "capture_key string, page_id long, record_type string, file string, offset long, length long, payload binary"


@dataclass
class Archive:
    manifest: DataFrame
    parts: DataFrame


def one_line(url: str) -> str:
    """Without characters that end a header or a field of an index line."""
    return url.replace("\n", "%0A").replace("\r", "%0D").replace("\t", "%09")


def reversed_host(url: str) -> str:
    """``com,example,www:8080)/path?query``: captures of a domain and its subdomains sort together."""
    try:
        at = urlsplit(url)
        host, port = at.hostname or "", f":{at.port}" if at.port else ""
    except ValueError:
        return url
    path = (at.path or "/") + (f"?{at.query}" if at.query else "")
    return f"{','.join(reversed(host.lower().split('.')))}{port}){path}" if host else url


def capture_key(url: str, page_id: int | None, digest: str) -> str:
    """Sorts by reversed-host URL, then page id, then the payload's hex digest. Captures with one key are alike in all of them."""
    place = 0 if page_id is None else page_id + (1 << 63)
    return f"{reversed_host(one_line(url))} {place:020d} {digest}"


def address(url: str | None, page_id: int | None) -> str:
    return one_line(url or f"urn:page:{page_id}")


def record_id(url: str, page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {digest} {url}'.encode('utf-8', 'replace')).digest())}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, target: tuple[int, str] | None) -> bytes:
    head = {
        "WARC-Type": "revisit" if target else "response",
        "WARC-Record-ID": record_id(url, page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type": "application/http; msgtype=response",
    }
    if page_id is not None:
        head["Page-ID"] = str(page_id)
    if target:
        head |= {
            "WARC-Profile": PROFILE,
            "WARC-Refers-To": record_id(target[1], target[0], digest),
            "WARC-Refers-To-Target-URI": target[1],
            "WARC-Refers-To-Date": DATE,
            "Refers-To-Page-ID": str(target[0]),
        }
    block = HTTP if target else HTTP + payload
    lines = "".join(f"{k}: {v}\r\n" for k, v in (head | {"Content-Length": len(block)}).items())
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (the block without its HTTP head) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def digest_of(fields: dict[str, str]) -> str:
    """The hex digest that a record's header gives for its payload."""
    return base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()


def checked(fields: dict[str, str], payload: bytes) -> bytes:
    if hashlib.sha1(payload).hexdigest() != digest_of(fields):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't what its digest says")
    return payload


def gzip_member(data: bytes, level: int) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def read_range(path: str, offset: int, length: int) -> bytes:
    where, at = store(path)
    with where.open_input_file(at) as f:
        return f.read_at(length, offset)


def write_records(batches: Iterator[pa.RecordBatch], folder: str, level: int, file_bytes: int) -> Iterator[pa.RecordBatch]:
    where, at = store(folder)
    out, name, size = None, "", 0
    try:
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, target_id, target_url in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or size >= file_bytes:
                    if out is not None:
                        out.close()
                    where.create_dir(at, recursive=True)
                    name, size = f"records-{uuid.uuid4().hex}.warc.gz", 0
                    out = where.open_output_stream(f"{at}/{name}", compression=None)
                url = address(url, page_id)
                target = None if target_id is None else (target_id, address(target_url, target_id))
                member = gzip_member(record(page_id, url, payload, digest, target), level)
                out.write(member)
                kind = "revisit" if target else "response"
                rows.append((page_id, capture_key(url, page_id, digest), url, kind, digest, f"{folder}/{name}", size, len(member)))
                size += len(member)
            columns = list(zip(*rows)) or [[]] * 8
            types = (pa.int64(), *[pa.string()] * 5, pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in MANIFEST.split(", ")])
    finally:
        if out is not None:
            out.close()


def write_index_part(batches: Iterator[pa.RecordBatch], folder: str, lines: int) -> Iterator[pa.RecordBatch]:
    """Blocks of ``lines`` sorted captures, then the directory: a line with first key, offset and length a block."""
    where, at = store(folder)
    name = f"index-{uuid.uuid4().hex}"
    directory, held, size, total, first, last = [], [], 0, 0, None, None
    out = None

    def flush():
        nonlocal size, held
        block = zlib.compress("\n".join(f"{k}\t{rest}" for k, rest in held).encode(), 6)
        out.write(block)
        directory.append(f"{held[0][0]}\t{size}\t{len(block)}")
        size, held = size + len(block), []

    for batch in batches:
        for row in batch.to_pylist():
            if out is None:
                where.create_dir(at, recursive=True)
                out, first = where.open_output_stream(f"{at}/{name}.blocks", compression=None), row["capture_key"]
            held.append((row["capture_key"], json.dumps([row["page_id"], row["record_type"], row["file"], row["offset"], row["length"]])))
            last, total = row["capture_key"], total + 1
            if len(held) >= lines:
                flush()
    if out is not None:
        if held:
            flush()
        out.close()
        with where.open_output_stream(f"{at}/{name}.directory", compression=None) as f:
            f.write("\n".join(directory).encode())
        yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "first_key": first, "last_key": last, "blocks": len(directory), "captures": total}])


class CaptureIndex:
    """A task's view: bounds of all parts, the directory and the block last used."""

    def __init__(self, parts: list[tuple[str, str, str]]):
        self.parts = sorted(parts)  # first key, last key, path
        self.firsts = [p[0] for p in self.parts]
        self.part, self.directory, self.keys = None, [], []
        self.block, self.lines, self.line_keys = None, [], []

    def find(self, key: str) -> tuple | None:
        """(page_id, record_type, file, offset, length) of a capture."""
        at = bisect_right(self.firsts, key) - 1
        if at < 0 or key > self.parts[at][1]:
            return None
        path = self.parts[at][2]
        if self.part != path:
            where, name = store(f"{path}.directory")
            with where.open_input_file(name) as f:
                self.directory = [line.rsplit("\t", 2) for line in f.read().decode().split("\n")]
            self.part, self.keys = path, [d[0] for d in self.directory]
        place = max(0, bisect_right(self.keys, key) - 1)
        if self.block != (path, place):
            data = zlib.decompress(read_range(f"{path}.blocks", int(self.directory[place][1]), int(self.directory[place][2])))
            self.lines = [line.split("\t", 1) for line in data.decode().split("\n")]
            self.block, self.line_keys = (path, place), [x[0] for x in self.lines]
        n = bisect_left(self.line_keys, key)
        return tuple(json.loads(self.lines[n][1])) if n < len(self.lines) and self.line_keys[n] == key else None


def find_captures(batches: Iterator[pa.RecordBatch], parts: list[tuple[str, str, str]]) -> Iterator[pa.RecordBatch]:
    index = CaptureIndex(parts)
    for batch in batches:
        rows = []
        for key in batch.column(0).to_pylist():
            if key is not None and (found := index.find(key)):
                page_id, kind, file, offset, length = found
                fields, payload = parse_record(zlib.decompress(read_range(file, offset, length), 31))
                rows.append((key, page_id, kind, file, offset, length, payload if kind == "revisit" else checked(fields, payload)))
        columns = list(zip(*rows)) or [[]] * 7
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in FOUND.split(", ")])


def members(path: str, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    where, at = store(path)
    with where.open_input_stream(at, compression=None) as f:
        inflate, out, data = zlib.decompressobj(31), [], b""
        while data or (data := f.read(chunk)):
            out.append(inflate.decompress(data))
            data = inflate.unused_data
            if inflate.eof:
                yield b"".join(out)
                inflate, out = zlib.decompressobj(31), []


def read_files(batches: Iterator[pa.RecordBatch], rows_at_once: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RECORDS.split(", ")]
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        for file in batch.column(0).to_pylist():
            rows = []
            for data in members(file):
                fields, payload = parse_record(data)
                page_id, target = fields.get("Page-ID"), fields.get("WARC-Refers-To-Target-URI")
                key = capture_key(target, int(fields["Refers-To-Page-ID"]), digest_of(fields)) if target else None
                rows.append((page_id and int(page_id), fields["WARC-Target-URI"], fields["WARC-Type"], key, None if target else checked(fields, payload)))
                if len(rows) >= rows_at_once:
                    yield pack(rows)
                    rows = []
            if rows:
                yield pack(rows)


def mark_revisits(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, payload, payload_digest, target_id, target_url (null for responses). Only payloads that may have an equal are shuffled."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least
    groups = (
        rows.where(large)
        .groupBy("payload_digest")
        .agg(F.max(F.struct("page_id", "url")).alias("target"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("payload_digest", F.col("target.page_id").alias("target_id"), F.col("target.url").alias("target_url"))
    )
    groups = materialize(groups, "equal-payloads")
    marked = may_be_in(rows, "payload_digest", groups, "payload_digest", "_likely")
    spread = marked.where("_likely").withColumn("spread", F.xxhash64("page_id", "url"))
    joined = salted_lookup(spread, groups, "payload_digest", "spread")
    alone = marked.where("not _likely").withColumns({c: F.lit(None).cast(groups.schema[c].dataType) for c in ("target_id", "target_url")})
    joined = joined.unionByName(alone, allowMissingColumns=True)
    other = F.col("target_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target_id"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        "payload_digest",
        F.when(other, F.col("target_id")).alias("target_id"),
        F.when(other, F.col("target_url")).alias("target_url"),
    )


def write_archive(pages: DataFrame, least: int = 1000, level: int = 3, file_bytes: int = 1 << 30, block_lines: int = 1000) -> Archive:
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = new_folder(spark, "warc")
    records = mark_revisits(pages, least).mapInArrow(partial(write_records, folder=f"{folder}/records", level=level, file_bytes=file_bytes), MANIFEST)
    manifest = materialize(records, "manifest")
    ordered = manifest.repartitionByRange("capture_key").sortWithinPartitions("capture_key")
    parts = materialize(ordered.mapInArrow(partial(write_index_part, folder=f"{folder}/index", lines=block_lines), PARTS), "index-parts")
    return Archive(manifest, parts)


def read_records(archive: Archive) -> DataFrame:
    """page_id, url, record_type, refers_key and payload (null for revisits) of every record, file by file."""
    files = archive.manifest.select("file").distinct()
    tasks = files.sparkSession.sparkContext.defaultParallelism * 3
    return files.repartition(tasks, "file").mapInArrow(partial(read_files, rows_at_once=256), RECORDS)


def lookup(archive: Archive, keys: DataFrame) -> DataFrame:
    """The captures and payloads of ``capture_key``s. The parts' bounds, one row an index file, go to every task."""
    parts = [(p.first_key, p.last_key, p.path) for p in archive.parts.collect()]
    near = keys.select("capture_key").repartitionByRange("capture_key").sortWithinPartitions("capture_key")
    return near.mapInArrow(partial(find_captures, parts=parts), FOUND)


def archive_report(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write ``pages``, read the archive back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    archive = write_archive(pages, least)
    measured = [F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")]
    records = materialize(read_records(archive).select("page_id", "record_type", "refers_key", *measured), "records")
    revisits = records.where("record_type = 'revisit'").select("page_id", "record_type", F.col("refers_key").alias("capture_key"))
    found = lookup(archive, revisits.select("capture_key").distinct()).select("capture_key", F.col("page_id").alias("refers_to"), *measured)
    resolved = salted_lookup(revisits, materialize(found, "found"), "capture_key", "page_id")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    return responses.select(columns).unionByName(resolved.select(columns))
