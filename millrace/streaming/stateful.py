"""Streams that remember: frames of sensors' byte streams, and a registry that admits a key once.

Framing keeps its state in RocksDB, the registry in the files it appends, so either may be larger than memory. Both survive restarts: what a batch that is repeated would change is
undone with it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StreamingQuery

from millrace.operators.sensors import take_frames

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
#: Frames that are handed on at a time.
PIECE = 10_000
#: Seqs whose early chunks are stored together.
BLOCK = 1024


def start(writer: DataStreamWriter, idle_batches: bool = False) -> StreamingQuery:
    """Start a stream that keeps its state in RocksDB. A query takes its settings when it starts, so the session's own are put back.

    With ``idle_batches`` timers also ring while no input comes. A stream that runs until nothing is left would then never end, so it must do without.
    """
    conf = writer._spark.conf
    wanted = {PROVIDER: ROCKS_DB, IDLE: str(idle_batches).lower()}
    before = {k: conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        conf.set(k, v)
    try:
        return writer.start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


class Framing(StatefulProcessor):
    """Chunks of a sensor in order of seq, from ``first`` on.

    The state is the next seq, the bytes that wait for more (31 at most), and chunks that came too early: those of BLOCK numbers in a row that come in one Arrow batch are one
    entry, and ``blocks`` has the number of entries of each block. So a task asks the store some times a block and batch, not a chunk, and holds one block and its Arrow batch at a time. A seq that
    has been used already is dropped; of chunks with one seq that both came early, or of which one waits already, the last counts. If the next chunk is missing for ``patience`` milliseconds, the
    frame it belongs to is given up and the first chunk that waits is next.
    """

    def __init__(self, first: int, patience: int):
        self.first, self.patience = first, patience

    def init(self, handle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "seq bigint, tail binary")
        self.blocks = handle.getMapState("blocks", "block bigint", "entries int")
        self.early = handle.getMapState("early", "block bigint, entry int", "chunks binary")

    def keep(self, chunks: dict[int, bytes], waiting: set[int]) -> None:
        """Store chunks, in ascending order of their seqs, by block."""
        for block, seqs in groupby(sorted(chunks), lambda seq: seq // BLOCK):
            n = self.blocks.getValue((block,))[0] if block in waiting else 0
            self.early.updateValue((block, n), (pickle.dumps([(seq, chunks[seq]) for seq in seqs]),))
            self.blocks.updateValue((block,), (n + 1,))
            waiting.add(block)

    def taken(self, block: int, waiting: set[int]) -> dict[int, bytes]:
        """The chunks of a block, which are no longer stored."""
        if block not in waiting:
            return {}
        waiting.remove(block)
        n, chunks = self.blocks.getValue((block,))[0], {}
        self.blocks.removeKey((block,))
        for entry in range(n):
            chunks.update(pickle.loads(bytes(self.early.getValue((block, entry))[0])))
            self.early.removeKey((block, entry))
        return chunks

    def waiting(self) -> set[int]:
        return {block for (block,) in self.blocks.keys()} if self.blocks.exists() else set()

    def framed(self, sensor, seq: int, tail: bytes, chunks: dict[int, bytes], waiting: set[int]) -> Iterator[pd.DataFrame]:
        """Frames of ``chunks`` and those that waited for them; ``place`` is where it ends, and what is too early yet is stored."""
        chunks = {at: chunk for at, chunk in chunks.items() if at >= seq}
        while seq in chunks or seq // BLOCK in waiting:
            stored = self.taken(seq // BLOCK, waiting)
            chunks = {at: chunk for at, chunk in stored.items() if at >= seq} | chunks
            parts, before = [tail], seq
            while seq in chunks and len(parts) <= BLOCK:
                parts.append(chunks.pop(seq))
                seq += 1
            frames, tail = take_frames(b"".join(parts))
            yield from self.given(sensor, frames)
            if seq == before:
                break
        self.keep(chunks, waiting)
        self.place.update((seq, tail))

    def given(self, sensor, frames: list[bytes]) -> Iterator[pd.DataFrame]:
        for i in range(0, len(frames), PIECE):
            piece = frames[i : i + PIECE]
            yield pd.DataFrame({"sensor": [sensor] * len(piece), "frame": piece})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, tail = self.place.get() if self.place.exists() else (self.first, b"")
        before, waiting = seq, self.waiting()
        for batch in rows:
            chunks, reached = {}, seq
            for at, chunk in zip(batch["seq"].tolist(), batch["data"]):
                if at >= reached:  # else it has been used
                    chunks[at] = b"" if chunk is None else bytes(chunk)
                    while reached in chunks:
                        reached += 1
            yield from self.framed(key[0], seq, bytes(tail), chunks, waiting)
            seq, tail = self.place.get()
        self.watch(seq != before, bool(waiting), timerValues)

    def watch(self, moved: bool, waiting: bool, timerValues) -> None:
        """A timer runs while chunks wait; it starts anew when the sequence has moved on."""
        timers = list(self.handle.listTimers())
        if timers and (moved or not waiting):
            for t in timers:
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            timers = []
        if waiting and not timers:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = self.waiting()
        if waiting:
            chunks = self.taken(min(waiting), waiting)
            yield from self.framed(key[0], min(chunks), b"", chunks, waiting)
            if waiting:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def close(self) -> None:
        pass


def frames_of_streams(chunks: DataFrame, first: int = 0, patience: int = 60_000) -> DataFrame:
    """sensor, frame of a stream of (sensor, seq, data) chunks: whatever the cuts into chunks and triggers, the frames of each sensor's whole byte stream. Null chunks are empty.

    Start it with ``start``.
    """
    grouped = chunks.select("sensor", "seq", "data").groupBy("sensor")
    kind = dict(chunks.dtypes)["sensor"]
    return grouped.transformWithStateInPandas(Framing(first, patience), f"sensor {kind}, frame binary", "Append", "ProcessingTime")


@dataclass(frozen=True)
class NewKeys:
    """A stream of scans (url, access_key) that has keys, and the stored registry it is held against."""

    scans: DataFrame
    registry: DataFrame


def new_keys(scans: DataFrame, registry: DataFrame) -> NewKeys:
    """url, access_key of a stream of scans: each key once, unless the stored registry has it. Scans without a key are left out. Start it with ``append_keys``."""
    return NewKeys(scans.select("url", "access_key").where("access_key is not null"), registry)


def unknown_keys(firsts: DataFrame, known: DataFrame) -> DataFrame:
    """``firsts`` without the known keys. Only known keys that are among them are kept to compare with, so a small batch moves no registry."""
    return firsts.join(known.join(firsts.select("access_key"), "access_key", "left_semi"), "access_key", "left_anti")


def append_keys(keys: NewKeys, path: str, checkpoint: str) -> StreamingQuery:
    """Append new keys to the registry's files, stamped, until nothing is left: of several urls of a key in a batch the smallest.

    The registry is read once, with the first batch; its keys then lie beside the checkpoint. A later batch is held against these and against what earlier batches have appended.
    Each batch has a folder of its own below ``path``, written anew if the batch is repeated, so nothing is appended twice. The registry must lie elsewhere.
    """
    spark, seed = keys.scans.sparkSession, f"{checkpoint}/registered"

    def append(scans: DataFrame, batch: int) -> None:
        if batch == 0:
            keys.registry.select("access_key").where("access_key is not null").write.mode("overwrite").parquet(seed)
        known = spark.read.schema("access_key string").parquet(seed, *(f"{path}/batch={b}" for b in range(batch)))
        firsts = scans.groupBy("access_key").agg(F.min("url").alias("url"))
        unknown_keys(firsts, known).select("url", "access_key", F.localtimestamp().alias("read_at")).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return keys.scans.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
