"""Sources that wait in a landing folder: posted or published messages, saved pages and images.

There is no broker or web server inside Spark: a collector drops messages as lines or files, and the stream reads each file once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def message_lines(spark: SparkSession, folder: str, streaming: bool = True) -> DataFrame:
    """payload: a message a line."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema("value string").format("text").load(folder).withColumnRenamed("value", "payload")


def saved_pages(spark: SparkSession, folder: str) -> DataFrame:
    """url (the file's path) and html of whole files."""
    return spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def uploaded_images(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of jpg, jpeg and png files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png}").load(folder).select("path", "content")
