"""Stored receipts: headers and items, upserted batch by batch, by a stream or by hand.

Rows lie in hash buckets of the access key. A batch writes the buckets it touches anew, beside what they were, in a folder of its own; other buckets keep their files.
A ledger entry, one file that is written last, says for each bucket which folder holds it now and for each source its last batch. Only what the last entry names is read: headers and
items change together, a batch that was killed has changed nothing, and repeating it writes the same folders again. A batch that the ledger has already is skipped.

An entry has a row for each table's bucket and each source. One writer at a time; folders that no entry names may be deleted when no reader needs them any more.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.receipts import header_rows, item_rows, upsert

TABLES = {
    "headers": ("access_key string, sold_at timestamp_ntz, payment string, total double", ["access_key"], header_rows),
    "items": ("access_key string, line_no int, product string, quantity double, unit_price double, item_total double", ["access_key", "line_no"], item_rows),
}
LEDGER = "name string, bucket int, folder string, batch long"


@dataclass
class Entry:
    """The state of the store: its number, the folder of each table's bucket, and the last batch of each source."""

    number: int = -1
    folders: dict[tuple[str, int], str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


def current(spark: SparkSession, path: str) -> Entry:
    try:
        ledger = spark.read.schema(f"{LEDGER}, entry long").option("basePath", f"{path}/ledger").parquet(f"{path}/ledger")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return Entry()
    number = ledger.agg(F.max("entry")).first()[0]
    if number is None:
        return Entry()
    rows = ledger.where(F.col("entry") == number).collect()  # a row a bucket or source
    return Entry(number, {(r.name, r.bucket): r.folder for r in rows if r.folder is not None}, {r.name: r.batch for r in rows if r.folder is None})


def write_entry(spark: SparkSession, path: str, entry: Entry) -> None:
    rows = [(n, b, f, None) for (n, b), f in entry.folders.items()] + [(s, None, None, b) for s, b in entry.batches.items()]
    spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/entry={entry.number}")


def stored(spark: SparkSession, path: str, name: str, buckets: list[int] | None = None, entry: Entry | None = None) -> DataFrame:
    """The rows of ``headers`` or ``items``, or of some of its buckets. Only the folders of these are listed and read."""
    entry = entry or current(spark, path)
    folders = [f"{path}/{name}/{folder}/bucket={b}" for (n, b), folder in entry.folders.items() if n == name and (buckets is None or b in buckets)]
    schema = TABLES[name][0]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert_notes(notes: DataFrame, path: str, source: str, batch: int, buckets: int = 64) -> None:
    """Upsert a batch of parsed notes. ``batch`` ascends within ``source``; ``buckets`` stays as it was when the store was begun."""
    spark = notes.sparkSession
    entry = current(spark, path)
    if batch <= entry.batches.get(source, -1):
        return
    notes = notes.persist()
    try:
        folder = f"{source}-{batch}"
        for name, (_, keys, rows) in TABLES.items():
            bucket = F.pmod(F.xxhash64("access_key"), F.lit(buckets)).cast("int")
            incoming = rows(notes)
            touched = [r[0] for r in incoming.select(bucket).distinct().collect()]  # numbers below ``buckets``
            if touched:
                merged = upsert(stored(spark, path, name, touched, entry), incoming, keys).withColumn("bucket", bucket)
                merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}/{folder}")
                entry.folders |= {(name, b): folder for b in touched}
        entry.batches[source] = batch
        entry.number += 1
        write_entry(spark, path, entry)
    finally:
        notes.unpersist()


def upsert_stream(notes: DataFrame, path: str, checkpoint: str, source: str = "stream", buckets: int = 64) -> StreamingQuery:
    """Upsert a stream of parsed notes until nothing is left. ``source`` names its checkpoint: a stream that begins anew needs another name."""
    writer = notes.writeStream.foreachBatch(lambda rows, batch: upsert_notes(rows, path, source, batch, buckets))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
