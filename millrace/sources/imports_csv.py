"""CSV of import values: the country is field 5, the commodity field 7, the value the last field (from 0)."""

from __future__ import annotations

import csv

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Positions in a row.
COUNTRY, COMMODITY = 5, 7
BAD = "_bad_row"
FIELDS = StructType([StructField(n, StringType()) for n in ("country", "commodity", "value")])


@F.pandas_udf(FIELDS)
def own_fields(rows: pd.Series) -> pd.DataFrame:
    """A row by its own length. Raises if it has no commodity."""
    parsed = [next(csv.reader([r])) for r in rows]
    for fields in parsed:
        if len(fields) <= COMMODITY:
            raise ValueError(f"row has only {len(fields)} fields: {','.join(fields)[:200]}")
    return pd.DataFrame([(f[COUNTRY], f[COMMODITY], f[-1]) for f in parsed], columns=FIELDS.names)


def load_imports(spark: SparkSession, path: str, mode: str = "permissive", multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(imports, rejects): country, commodity, value as text, and the raw rows of another length than the header.

    ``strict`` reads rows that are too long by their own last field and fails on rows that are too short; ``permissive``
    rejects both. ``multi_line=False`` lets large files be split where no field holds a line break.
    """
    if mode not in ("permissive", "strict"):
        raise ValueError("mode is permissive or strict")
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("encoding", "UTF-8").option("columnPruning", False)  # else over-long rows pass as plain
    n = len(reader.csv(path).columns)
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(n)] + [StructField(BAD, StringType())])
    rows = reader.schema(schema).option("columnNameOfCorruptRecord", BAD).csv(path)
    plain = rows.where(F.col(BAD).isNull()).select(F.col(f"c{COUNTRY}").alias("country"), F.col(f"c{COMMODITY}").alias("commodity"), F.col(f"c{n - 1}").alias("value"))
    odd = rows.where(F.col(BAD).isNotNull()).select(F.rtrim(F.coalesce(F.col(BAD), F.col("c0")), F.lit("\r\n")).alias("raw"))  # Spark refuses to read that column alone
    if mode == "permissive":
        return plain, odd
    reread = odd.select(own_fields("raw").alias("f")).select("f.*")
    return plain.unionByName(reread), odd.where(F.lit(False))
