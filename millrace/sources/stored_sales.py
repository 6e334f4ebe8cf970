"""Sales stored by month, and the calendar that chooses among them.

A filter on dates is turned into one on months too, so that other months' folders aren't even listed for the scan. Days that are known only by what a calendar says of them
(weekends, a quarter, an ISO week) are chosen by a join with it: Spark reads the calendar first and then only the months it has left (dynamic partition pruning).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.sales import ALL_PAYMENTS, filter_sales

#: More days than this (about 270 years) are a mistake in the dates, not a calendar to broadcast.
MOST_DAYS = 100_000


def month_of(sold: Column) -> Column:
    return F.year(sold) * 100 + F.month(sold)


def store_by_month(sales: DataFrame, path: str) -> None:
    """Write ``sales`` (with sold_at) to a new folder, a sub-folder a month. Sales without a time have one of their own.

    Ranges are cut by month and time, so a month that holds a large part of all rows is written by several tasks. A column named month is replaced.
    """
    rows = sales.withColumn("month", month_of(F.col("sold_at")))
    rows.repartitionByRange("month", "sold_at", F.xxhash64(*(c for c in sales.columns if c != "month"))).sortWithinPartitions("month", "sold_at").write.partitionBy("month").parquet(path)


def stored_sales(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored sales with their month; ``schema`` is that of the stored columns."""
    return spark.read.schema(f"{schema}, month int").parquet(path)


def sales_between(stored: DataFrame, start: date, end: date, payment: str = ALL_PAYMENTS, inclusive_end_day: bool = False) -> DataFrame:
    """``filter_sales`` of stored sales. Only the months from that of ``start`` to that of ``end`` are read."""
    months = F.col("month").between(start.year * 100 + start.month, end.year * 100 + end.month)
    return filter_sales(stored.where(months), start, end, payment, inclusive_end_day)


def store_calendar(sales: DataFrame, path: str) -> None:
    """Write a row for each day from the first sale to the last: day, month, year, quarter, week (ISO), week_year, weekday (Monday is 1). Without sales there are none.

    Fails where the dates span more than ``MOST_DAYS``: the calendar is broadcast.
    """
    span = sales.select(F.to_date("sold_at").alias("day")).agg(F.min("day").alias("low"), F.max("day").alias("high")).where(F.col("low").isNotNull())
    wrong = F.raise_error(F.concat(F.lit("sales span too many days for a calendar: "), F.col("low").cast("string"), F.lit(" to "), F.col("high").cast("string")))
    days = F.when(F.date_diff("high", "low") >= MOST_DAYS, wrong.cast("array<date>")).otherwise(F.sequence("low", "high"))
    day = F.col("day")
    told = {
        "month": month_of(day), "year": F.year(day), "quarter": F.quarter(day), "week": F.weekofyear(day),
        "week_year": F.extract(F.lit("YEAROFWEEK"), day).cast("int"), "weekday": F.weekday(day) + 1,
    }
    span.select(F.explode(days).alias("day")).select("day", *(c.alias(n) for n, c in told.items())).coalesce(1).write.parquet(path)


CALENDAR = "day date, month int, year int, quarter int, week int, week_year int, weekday int"


def stored_calendar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALENDAR).parquet(path)


def sales_on(stored: DataFrame, days: DataFrame) -> DataFrame:
    """The stored sales of ``days``, which are rows of a calendar that a filter has left, each day once. Sales without a time are on no day."""
    chosen = F.broadcast(days.select(F.col("month").alias("_month"), F.col("day").alias("_day")))  # at most MOST_DAYS rows
    return stored.join(chosen, (F.col("month") == F.col("_month")) & (F.to_date("sold_at") == F.col("_day"))).drop("_month", "_day")
