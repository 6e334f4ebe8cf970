"""Telemetry ingest: JSON messages to documents, in batch or streaming with the same transformation."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType

from millrace.functions.scalars import name_based_id, object_keys, timestamp_text, valid_utf8

# Keys that a posted document must have, in the order they are checked, and the texts of the answers.
REQUIRED = ["temperatura", "umidade_ar", "umidade_solo"]
ABSENT = "Campo '%s' ausente no JSON"
STORED = "Dados recebidos e armazenados com sucesso!"
STAMP_KEY = "dataRegistro"

#: Names of stored posts are made unique within this name space.
POSTS = uuid.uuid5(uuid.NAMESPACE_URL, "urn:posts")


def allow_repeated_keys(spark: SparkSession) -> None:
    """Of repeated keys in an object the last wins."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def decode_telemetry(messages: DataFrame, payload: str = "payload", received_at: Column | None = None) -> DataFrame:
    """``messages`` with doc (VARIANT), received_at and error_kind (null if good).

    A message is good when it is UTF-8 and a JSON object; of repeated keys the last wins, for which the session's setting is made. The stamp is a column of its
    own and wins over a key of that name in the body.
    """
    allow_repeated_keys(messages.sparkSession)
    text = valid_utf8(F.col(payload)) if dict(messages.dtypes)[payload] == "binary" else F.col(payload)
    doc = F.try_parse_json("_text")
    kind = (
        F.when(F.col("_text").isNull(), "not text")
        .when(F.col("doc").isNull(), "not JSON")
        .when(~F.schema_of_variant("doc").startswith("OBJECT"), "not an object")
    )
    stamp = F.current_timestamp() if received_at is None else received_at
    return messages.withColumn("_text", text).withColumn("doc", doc).withColumn("error_kind", kind).withColumn("received_at", stamp).drop("_text")


def good(decoded: DataFrame) -> DataFrame:
    return decoded.where("error_kind is null").drop("error_kind")


def dead_letters(decoded: DataFrame) -> DataFrame:
    return decoded.where("error_kind is not null").drop("doc")


def gate_required(posts: DataFrame, body: str = "body", keys: list[str] = REQUIRED, registered_at: Column | None = None) -> DataFrame:
    """``posts`` with status_code (201 or 400), message, registered_at.

    Keys are checked in order and the first absent one is named; a key with a null value is present, and so is one that repeats. The answer
    depends on no setting of the session.
    """
    held = object_keys(F.col(body))
    checked = posts.withColumn("_held", held)
    error = F.when(F.col("_held").isNull(), F.lit("not a JSON object"))
    for key in keys:
        error = error.when(~F.array_contains("_held", key), F.lit(ABSENT.replace("%s", key)))
    checked = checked.withColumn("_error", error)
    stamp = F.current_timestamp() if registered_at is None else registered_at
    return (
        checked.withColumn("status_code", F.when(F.col("_error").isNull(), 201).otherwise(400))
        .withColumn("message", F.coalesce("_error", F.lit(STORED)))
        .withColumn("registered_at", F.when(F.col("_error").isNull(), timestamp_text(stamp)))
        .drop("_error", "_held")
    )


@F.pandas_udf(StringType())
def stamped_body(bodies: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The body as it is answered: the stamp in place of a client's, of repeated keys the last."""
    for body, stamp in bodies:
        yield pd.Series([json.dumps(json.loads(b) | {STAMP_KEY: t}, ensure_ascii=False) for b, t in zip(body, stamp)])


def stored_posts(gated: DataFrame, body: str = "body", delivery: list[str] | None = None) -> DataFrame:
    """Accepted posts as they are stored and answered: an id, and dados, the body with the stamp.

    The id is made of the ``delivery`` columns (default: all that the post came with), so a task that is repeated gives the same one. They must tell two posts
    with the same body apart, as a place in a log does.
    """
    own = delivery or [c for c in gated.columns if c not in ("status_code", "message", "registered_at")]
    name = F.to_json(F.struct(*own), {"ignoreNullFields": "false"})
    accepted = gated.where("status_code = 201")
    return accepted.withColumn("id", name_based_id(POSTS, name)).withColumn("dados", stamped_body(body, "registered_at"))


def store_outcomes(decoded: DataFrame, folder: str, batch: int) -> None:
    """Write good messages and dead letters of a batch in one pass: outcome=good and outcome=dead below the batch's folder, which is replaced if it is there."""
    outcome = F.when(F.col("error_kind").isNull(), "good").otherwise("dead")
    decoded.withColumn("outcome", outcome).write.mode("overwrite").partitionBy("outcome").parquet(f"{folder}/batch={batch}")


def outcomes(spark: SparkSession, folder: str, outcome: str) -> DataFrame:
    """What ``store_stream`` has stored as good or dead."""
    return spark.read.option("basePath", folder).parquet(f"{folder}/batch=*").where(F.col("outcome") == outcome).drop("outcome")


def store_stream(decoded: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Store decoded messages until nothing is left, each either good or dead. A batch that is repeated after a restart replaces its own folder, so nothing is there twice or missing."""
    writer = decoded.writeStream.foreachBatch(lambda rows, batch: store_outcomes(rows, folder, batch))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to Parquet files. Restarting from the checkpoint writes nothing twice."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
