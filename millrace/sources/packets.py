"""Recorded publish packets as a source and a sink: ``spark.read.format("recorded_packets")``, ``readStream`` and ``write``.

A recorder lays the bytes that a message broker sends into files of a folder: control packets one after another, each with a fixed header of one byte, a
variable-length size, and, if it publishes, a topic, a packet number (with quality 1 or 2) and a payload. Packets of other kinds are skipped. A file
is complete once it is in the folder, and names ascend with time. A task reads a file, a packet at a time, so memory is bounded by the largest packet.

The stream's offset is the name of the last file that was read, so a restart from the checkpoint goes on behind it and repeats nothing.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "topic string, payload binary, quality int, retained boolean, packet_number int, file string, position long"
# The format's packet type, and the bits of its first byte.
PUBLISH, SUFFIX = 3, ".packets"


def size_bytes(n: int) -> bytes:
    """A size as the format writes it: seven bits a byte, the lowest first, and the eighth bit set where more follow."""
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def packet(topic: str, payload: bytes, quality: int = 0, retained: bool = False, number: int = 1) -> bytes:
    name = topic.encode()
    body = len(name).to_bytes(2, "big") + name + (number.to_bytes(2, "big") if quality else b"") + payload
    return bytes([PUBLISH << 4 | quality << 1 | retained]) + size_bytes(len(body)) + body


def packets(data) -> Iterator[tuple[int, int, bytes]]:
    """Position, first byte and body of each packet of a stream. A packet that the end cuts off isn't given."""
    position = 0
    while head := data.read(1):
        size, shift, read = 0, 0, 1
        while shift < 28 and (byte := data.read(1)):
            size |= (byte[0] & 127) << shift
            shift, read = shift + 7, read + 1
            if byte[0] < 128:
                break
        else:
            if shift < 28:
                return
            raise ValueError(f"no packet at byte {position}")
        body = data.read(size)
        if len(body) < size:
            return
        yield position, head[0], body
        position += read + size


def published(first: int, body: bytes) -> tuple[str, bytes, int, bool, int | None]:
    quality = first >> 1 & 3
    end = 2 + int.from_bytes(body[:2], "big")
    number = int.from_bytes(body[end : end + 2], "big") if quality else None
    return body[2:end].decode("utf-8", "replace"), body[end + 2 * bool(quality) :], quality, bool(first & 1), number


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def file_names(folder: str, after: str = "", until: str | None = None) -> list[str]:
    where, at = store(folder)
    found = where.get_file_info(fs.FileSelector(at, allow_not_found=True))
    names = sorted(posixpath.basename(f.path) for f in found if f.type == fs.FileType.File and f.path.endswith(SUFFIX))
    return [n for n in names if n > after and (until is None or n <= until)]


@dataclass
class File(InputPartition):
    name: str


def messages_of(folder: str, name: str) -> Iterator[tuple]:
    where, at = store(folder)
    with where.open_input_stream(f"{at}/{name}") as data:
        for position, first, body in packets(data):
            if first >> 4 == PUBLISH:
                yield (*published(first, body), name, position)


class PacketReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        return [File(n) for n in file_names(self.folder)]

    def read(self, partition: File | None):
        return iter(()) if partition is None else messages_of(self.folder, partition.name)  # none: an empty folder


class PacketStream(DataSourceStreamReader):
    """A batch takes all files that have come since the last one, a task a file."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self):
        return {"file": ""}

    def latestOffset(self):
        return {"file": max(file_names(self.folder), default="")}

    def partitions(self, start: dict, end: dict):
        return [File(n) for n in file_names(self.folder, start["file"], end["file"])]

    def read(self, partition: File):
        return messages_of(self.folder, partition.name)

    def commit(self, end: dict):
        pass


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class PacketWriter(DataSourceWriter):
    """Each task writes its rows (topic, payload) to a file that gets its name when all tasks are done."""

    def __init__(self, folder: str, schema):
        self.folder = folder
        self.topic, self.payload = schema.fieldNames().index("topic"), schema.fieldNames().index("payload")

    def write(self, iterator):
        where, at = store(self.folder)
        where.create_dir(at, recursive=True)
        name = None
        out = None
        for row in iterator:
            if out is None:
                name = uuid.uuid4().hex
                out = where.open_output_stream(f"{at}/{name}.part", compression=None)
            out.write(packet(row[self.topic] or "", bytes(row[self.payload] or b"")))
        if out is not None:
            out.close()
        return Written(name)

    def commit(self, messages):
        where, at = store(self.folder)
        first = len(file_names(self.folder))
        for i, m in enumerate(m for m in messages if m is not None and m.name):
            where.move(f"{at}/{m.name}.part", f"{at}/{first + i:012d}-{m.name}{SUFFIX}")

    def abort(self, messages):
        where, at = store(self.folder)
        for m in messages:
            if m is not None and m.name:
                where.delete_file(f"{at}/{m.name}.part")


class RecordedPackets(DataSource):
    @classmethod
    def name(cls):
        return "recorded_packets"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PacketReader(self.options["path"])

    def streamReader(self, schema):
        return PacketStream(self.options["path"])

    def writer(self, schema, overwrite):
        return PacketWriter(self.options["path"], schema)


def recorded_messages(spark: SparkSession, folder: str, topic: str | None = None, streaming: bool = True) -> DataFrame:
    """The published messages of a folder: topic, payload and where each stands. One ``topic`` (compared as it is) or all."""
    spark.dataSource.register(RecordedPackets)
    reader = (spark.readStream if streaming else spark.read).format("recorded_packets")
    found = reader.load(folder)
    return found if topic is None else found.where(found.topic == topic)


def record_messages(messages: DataFrame, folder: str) -> None:
    """Write (topic, payload) rows as recorded packets."""
    messages.sparkSession.dataSource.register(RecordedPackets)
    messages.select("topic", "payload").write.format("recorded_packets").mode("append").save(folder)
