"""Imports stored for lookups by commodity: rows lie in the order of their commodities, and readers skip the row groups that can't hold the one asked for.

A row group's smallest and largest commodity rule out most of them; what lies between is ruled out by the column's dictionary, or by its Bloom filter where there were too many
values for a dictionary. All three are Parquet's, written by options and used by Spark's scan without a word in the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "country string, commodity string, value {}"


def store_by_commodity(imports: DataFrame, path: str, block_bytes: int = 64 << 20, dictionary: bool = True, values_of_block: int = 1_000_000) -> None:
    """Write country, commodity, value to a new folder. Null commodities come first; other columns are left out.

    Ranges are cut by commodity and country, so a commodity that holds a large part of all rows fills as many files as it needs. ``values_of_block`` is how many commodities a
    block's Bloom filter is laid out for: more of them make it less sharp, never wrong.
    """
    rows = imports.select("country", "commodity", "value").repartitionByRange("commodity", "country", F.xxhash64("value")).sortWithinPartitions("commodity", "country")
    options = {
        "parquet.block.size": block_bytes,
        "parquet.enable.dictionary#commodity": str(dictionary).lower(),
        "parquet.bloom.filter.enabled#commodity": "true",
        "parquet.bloom.filter.expected.ndv#commodity": values_of_block,
        "compression": "zstd",
    }
    rows.write.options(**options).parquet(path)


def stored_imports(spark: SparkSession, path: str, value: str = "double") -> DataFrame:
    """The stored rows; ``value`` is the type that values were stored with. ``countries_by_commodity`` and the other lookups take them as any imports."""
    return spark.read.schema(SCHEMA.format(value)).parquet(path)
