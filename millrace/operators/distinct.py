"""Distinct commodities counted by bitmaps, so that counts can be added up further without the rows, the pairs or any list.

Commodities get numbers in their own order, stored once. A country's commodities are bits: a row for each country and block of 32,768 numbers, with 4 KB of bits, is all that is
shuffled or kept. Countries' bitmaps, or those of several days, are put together by OR, which a sum of counts can't do. Null is a commodity or country like another, as in any grouping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.folders import written


def commodity_numbers(imports: DataFrame) -> DataFrame:
    """commodity, number (from 1): ascending with the commodity, without gaps within a range of commodities. Written once, so that numbers stay."""
    names = imports.select("commodity").distinct().repartitionByRange("commodity").sortWithinPartitions("commodity")
    return written(names.select("commodity", (F.monotonically_increasing_id() + 1).alias("number")), "numbers")


def commodity_bitmaps(imports: DataFrame, numbers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys (the country), block, bits: which commodities there are. All of them must have a number; one without fails."""
    keys = keys or ["country"]
    known = numbers.select(F.col("commodity").alias("_name"), "number")
    lost = F.raise_error(F.concat(F.lit("commodity without a number: "), F.coalesce("commodity", F.lit("null")))).cast("long")
    told = imports.join(known, F.col("commodity").eqNullSafe(F.col("_name")), "left").select(*keys, F.coalesce("number", lost).alias("number"))
    block = F.bitmap_bucket_number("number").alias("block")
    return told.select(*keys, block, F.bitmap_bit_position("number").alias("bit")).groupBy(*keys, "block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def merged_bitmaps(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """Bitmaps by ``keys``, of which they have more: those of equal keys are put together."""
    return bitmaps.groupBy(*keys, "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def commodity_counts(bitmaps: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, n_commodities."""
    return bitmaps.groupBy(*(keys or ["country"])).agg(F.sum(F.bitmap_count("bits")).alias("n_commodities"))
