"""Shards of equal row counts along a Hilbert curve, in DataFrame operations only.

Several metadata dimensions are quantised to a few bits each. The curve visits every cell of that
grid once and neighbours on it differ in one dimension by one step, so a run of the curve covers a
small box of the metadata space. Rows are ordered by curve index and cut into runs; each file then has
narrow ranges in all dimensions at once and a filter on any of them skips most files.

Law ``rows``: shard sizes differ by at most one row. Nulls in a dimension go to step 0, a null text has
no bytes, repeated rows take slots of their own, and an empty table gives no rows. Texts are moved whole, however long. ``write_shards`` keeps
all columns of the rows; its own are renamed where they clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import fresh, materialize, new_folder


def hashed_step(value: Column, bits: int) -> Column:
    """A category's step: equal values share a step, so an equality filter still prunes."""
    return F.when(value.isNull(), 0).otherwise(F.pmod(F.xxhash64(value), F.lit(1 << bits))).cast("int")


def log_step(value: Column, bits: int) -> Column:
    """A size's step: its number of binary digits, capped at the last step."""
    digits = F.length(F.bin(F.greatest(value, F.lit(0)).cast("long")))
    return F.least(F.coalesce(digits, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def hilbert_curve(spark: SparkSession, dims: int, bits: int) -> DataFrame:
    """cell (the steps as one number, first dimension highest) and curve (its index), for the whole grid.

    Runs the transpose form of the curve: undo the excess work from the highest bit down, Gray-encode,
    then interleave the bits. The grid has 2^(dims*bits) rows whatever the data's size.
    """
    if dims * bits > 16 or bits < 2:
        raise ValueError("a step needs two bits at least and the grid must stay within 65536 cells")
    last = bits * dims - 1
    steps = ", ".join(f"cast(shiftright(id, {bits * (dims - 1 - i)}) & {(1 << bits) - 1} as int)" for i in range(dims))
    high = f"shiftleft(1, {bits - 1} - cast(k div {dims} as int))"
    undone = f"""
        aggregate(sequence(0, {last}), array({steps}), (s, k) -> transform(s, (v, j) -> CASE
            WHEN (s[k % {dims}] & {high}) != 0 THEN if(j = 0, v ^ ({high} - 1), v)
            WHEN j = 0 OR j = k % {dims} THEN v ^ ((s[0] ^ s[k % {dims}]) & ({high} - 1))
            ELSE v END))"""
    gray = "transform(s, (v, j) -> aggregate(slice(s, 1, j + 1), 0, (x, y) -> x ^ y))"
    turn = f"aggregate(sequence(1, {bits - 1}), 0, (t, l) -> if((g[{dims - 1}] & shiftleft(1, l)) != 0, t ^ (shiftleft(1, l) - 1), t))"
    index = f"aggregate(sequence(0, {last}), 0, (h, k) -> h * 2 + (shiftright(g[k % {dims}] ^ q, {bits - 1} - cast(k div {dims} as int)) & 1))"
    curve = f"transform(array({undone}), s -> transform(array({gray}), g -> transform(array({turn}), q -> {index})[0])[0])[0]"
    grid = spark.range(1 << (dims * bits), numPartitions=1).withColumn("id", F.col("id").cast("int"))
    return grid.select(F.col("id").alias("cell"), F.expr(curve).cast("int").alias("curve"))


def hilbert_shards(rows: DataFrame, steps: list[Column], bits: int, shards: int, order: list[str], salt_rows: int = 500_000) -> DataFrame:
    """``rows`` with curve, shard and slot: runs of the curve with equal row counts. They come in order of the curve.

    A first pass counts rows by cell, over the metadata columns alone. A cell is cut into salts by a hash, of about ``salt_rows`` rows
    or less, so that one hot cell isn't sorted by one task. Rows are moved once, into ranges of cells and salts: a row's place is the number of rows in earlier
    cells and salts plus its rank in its own. Shard and slot follow from the place by arithmetic.
    """
    spark = rows.sparkSession
    number = sum((s.cast("int") * F.lit(1 << (bits * (len(steps) - 1 - i))) for i, s in enumerate(steps)), F.lit(0))
    placed = rows.withColumn("cell", number.cast("int")).join(F.broadcast(hilbert_curve(spark, len(steps), bits)), "cell").drop("cell")
    cells = materialize(placed.groupBy("curve").agg(F.count(F.lit(1)).alias("_n")), "cells")  # at most 65536 rows
    salts = cells.select("curve", F.expr(f"greatest(8, _n div {salt_rows} + 1)").alias("_salts"))
    salted = placed.join(F.broadcast(salts), "curve").withColumn("_salt", F.pmod(F.xxhash64(*order), "_salts")).drop("_salts")
    counts = salted.groupBy("curve", "_salt").agg(F.count(F.lit(1)).alias("_n"))  # as many rows as cells and salts, whatever the data's size
    earlier = Window.partitionBy(F.lit(0)).orderBy("curve", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("curve", "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_total"))
    within = Window.partitionBy("curve", "_salt").orderBy(*order)
    shard = F.expr(f"cast((_place * {shards}) div _total as int)")
    first = F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    return (
        salted.repartitionByRange("curve", "_salt")
        .withColumn("_row", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["curve", "_salt"])
        .withColumn("_place", F.col("_before") + F.col("_row"))
        .withColumn("shard", shard)
        .withColumn("slot", (F.col("_place") - first).cast("long"))
        .drop("_before", "_total", "_place", "_row", "_salt")
    )


def shard_rows(docs: DataFrame, shards: int = 8, bits: int = 4) -> DataFrame:
    """document (all columns of the row), curve, shard, slot."""
    rows = docs.select("doc_id", "lang", "source", "n_chars", F.struct(*docs.columns).alias("document"))
    steps = [hashed_step(F.col("lang"), bits), hashed_step(F.col("source"), bits), log_step(F.col("n_chars"), bits)]
    return hilbert_shards(rows, steps, bits, shards, ["doc_id"]).select("document", "curve", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8, bits: int = 4) -> DataFrame:
    """Write the rows of ``docs`` with shard, slot and curve as Parquet, a folder a shard, and read them back.

    Files hold runs of the curve in its order, so a filter on any dimension skips most of them.
    """
    shard, slot, curve = (fresh(docs, n) for n in ("shard", "slot", "curve"))
    rows = shard_rows(docs, shards, bits).select("document.*", F.col("slot").alias(slot), F.col("curve").alias(curve), F.col("shard").alias(shard))
    rows.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def shard_documents(docs: DataFrame, shards: int = 8, bits: int = 4) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot, grown_shard, curve of the shards, which are written first."""
    documents = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return write_shards(documents, new_folder(docs.sparkSession, "shards"), shards, bits).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )
