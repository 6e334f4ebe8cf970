"""Helpers that several operators share: written intermediates, salted ranks and joins, batch bounds."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of an Arrow batch sent to Python: bounds a task's memory when texts are long.
BATCH_ROWS = 256


def workspace(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/millrace"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{workspace(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: what follows reads a table that outlives any executor, and work that several
    later steps need is done once.
    """
    spark, schema = df.sparkSession, df.schema
    path = new_folder(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows`` if it is larger; it stays so, as the plan runs later."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def fresh(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def salt_of(by: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")


def salted_rank(df: DataFrame, key: str, order: list[str], salts: DataFrame, name: str = "rank") -> DataFrame:
    """0-based rank of each row within ``key``, gapless, without gathering a key in one task.

    ``salts`` (``key``, _salts) says for each key into how many salts it is cut. Rows are dealt by (key, salt); each salt's start is the number of rows in the key's
    earlier salts. Both tables are broadcast: the starts have as many rows as ``salts`` adds up to, which the caller must keep small.
    """
    salted = df.join(F.broadcast(salts), key).withColumn("_salt", F.pmod(F.xxhash64(*order), "_salts").cast("int")).drop("_salts")
    earlier = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        salted.groupBy(key, "_salt")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(key, "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy(key, "_salt").orderBy(*order)
    return (
        salted.withColumn("_row", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), [key, "_salt"])
        .withColumn(name, F.col("_start") + F.col("_row"))
        .drop("_salt", "_row", "_start")
    )


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, spread: str, salts: int = 32, how: str = "left") -> DataFrame:
    """Join ``rows`` to a table with one row a key when a key may hold a large share of ``rows``.

    Each row of ``table`` is repeated once a salt and the rows pick a salt by ``spread``, so a hot key
    is dealt to ``salts`` tasks. Costs ``salts`` copies of the small side, nothing on the large one.
    """
    left = rows.withColumn("_salt", salt_of(F.col(spread), salts))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def hand_back() -> None:
    """Give freed memory of this worker back to the machine: workers outlive their tasks, and what they hold counts beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class RecentCache:
    """Values by key for the keys met lately: at most two generations of ``most`` entries each.

    A full young generation becomes the old one; keys met again move back, so frequent ones stay.
    """

    def __init__(self, make, most: int):
        self.make, self.most = make, most
        self.young: dict = {}
        self.old: dict = {}

    def forget_old(self) -> None:
        self.old = {}

    def peek(self, key):
        """The value of a key met lately, or None."""
        value = self.young.get(key)
        return self.old.get(key) if value is None else value

    def covering(self, met: set) -> dict:
        """A dictionary that has all of ``met``; ``make`` gets the list of keys that are new."""
        missing = met.difference(self.young)
        if self.young and len(self.young) + len(missing) > self.most:
            self.old, self.young, missing = self.young, {}, met
        again = {k for k in missing if k in self.old}
        self.young.update((k, self.old[k]) for k in again)
        new = list(missing.difference(again))
        self.young.update(zip(new, self.make(new)))
        return self.young


BITMAP_BITS = 1 << 26


def may_be_in(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str, flag: str = "may_be_in") -> DataFrame:
    """``rows`` plus a column ``flag``: false only if ``key`` is surely not among the wanted keys.

    The wanted keys set bits of a bitmap of fixed size (8 MB in all, cut into rows of 4 KB), which is broadcast.
    It spares the shuffle of rows that no join needs; when it is full, rows are only shuffled in vain.
    """
    place, bucket, bits = (fresh(rows, n) for n in ("_place", "_bucket", "_bitmap"))
    bitmap = (
        wanted.select(F.pmod(F.xxhash64(F.col(wanted_key)), F.lit(BITMAP_BITS)).alias(place))
        .groupBy(F.expr(f"bitmap_bucket_number({place})").alias(bucket))
        .agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({place}))").alias(bits))
    )
    placed = rows.withColumn(place, F.pmod(F.xxhash64(F.col(key)), F.lit(BITMAP_BITS))).withColumn(bucket, F.expr(f"bitmap_bucket_number({place})"))
    bit = f"bitmap_bit_position({place})"
    byte = f"cast(conv(hex(substring({bits}, cast({bit} div 8 as int) + 1, 1)), 16, 10) as int)"
    found = placed.join(F.broadcast(bitmap), bucket, "left")
    return found.withColumn(flag, F.expr(f"coalesce((shiftright({byte}, cast({bit} % 8 as int)) & 1) = 1, false)")).drop(place, bucket, bits)
