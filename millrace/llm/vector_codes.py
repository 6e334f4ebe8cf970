"""Vectors as short codes: each vector is cut into parts, and each part is replaced by the index of its nearest codebook entry.

Delta-maintained Lloyd: the vectors are turned into integers and written once, in buckets of a row number. A round joins them with the
assignments that the round before wrote, bucket to bucket and so without a shuffle, assigns every part anew and writes the new assignments. A task adds up what its
changed parts take from their old entries and bring to their new ones: at most a row for each entry, beside its last assignments.
Only these contributions are shuffled; they keep the running sums and counts of all entries right, so a late round, in which
few parts move, moves few numbers. All of it is integer arithmetic, so results don't depend on the order of rows or on partitions.

What the driver holds is the codebooks, sums and counts: entries x dimensions numbers, whatever the number of vectors.

Rows whose vector is null or empty or holds a null or non-finite component are dropped. All others must have one length that the number of parts
divides, and components of at most ``LARGEST`` after scaling (errors would leave 64 bits otherwise): else the job fails with a message. The first
codebooks come from the smallest ids (null ids last; of equal ids the smaller vector first), or from all where there are fewer. Rows that repeat an id are rows of their own. Null
labels are one label. Only the id, vector and label columns are read, so other columns may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, materialize, new_folder

#: Vectors of an Arrow batch, and the largest scaled component: squared distances of up to 1024 components fit 64 bits.
BATCH, LARGEST = 2048, 1 << 25
DELTA = "array<struct<slot: int, n: bigint, sums: array<bigint>>>"
STATE = f"row long, code binary, delta {DELTA}"
DELTA_TYPE = pa.list_(pa.struct([("slot", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))


def scaled(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """row, vec_id, label and ints of the rows that take part."""
    sound = "size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).where(f"vector is not null and {sound}")
    large = f"exists(vector, x -> abs(x) * {scale} >= {LARGEST})"
    ints = F.expr(f"if({large}, raise_error('a vector has a component beyond {LARGEST // scale}'), transform(vector, x -> cast(floor(x * {scale}) as int)))")
    return kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", ints.alias("ints"))


class Buckets:
    """Tables in the shared folder that are bucketed alike, so that joins on ``row`` need no shuffle. Spark knows bucketing by a table's name; names are dropped at the end, files stay."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []
        self.n = min(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))

    def write(self, rows: DataFrame, label: str) -> DataFrame:
        name = f"{label}_{uuid.uuid4().hex}"
        self.names.append(name)
        rows.write.bucketBy(self.n, "row").option("path", new_folder(self.spark, label)).format("parquet").saveAsTable(name)
        return self.spark.table(name)

    def forget(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of a matrix. All lists have one length."""
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


def nearest_entries(parts: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry of each part (rows x parts x width), ties to the lower index."""
    codes = np.empty(parts.shape[:2], np.uint8)
    far = np.empty(parts.shape[:2], np.int64)
    for p in range(parts.shape[1]):
        distances = ((parts[:, p, None, :] - codebooks[p][None]) ** 2).sum(axis=2)
        codes[:, p] = distances.argmin(axis=1)
        far[:, p] = distances[np.arange(len(parts)), codes[:, p]]
    return codes, far


def reassign(batches: Iterator[pa.RecordBatch], codebooks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(row, ints, code so far or null) to STATE: the new codes; the last batch's first row has what the task's changed parts take and bring."""
    n_parts, n_entries, width = codebooks.shape
    sums, counts = np.zeros(codebooks.shape, np.int64), np.zeros((n_parts, n_entries), np.int64)
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = matrix(batch.column(1)).reshape(-1, n_parts, width)
        codes, _ = nearest_entries(parts, codebooks)
        before = [c if c is None else np.frombuffer(c, np.uint8) for c in batch.column(2).to_pylist()]
        known = np.array([c is not None for c in before])
        old = np.stack([np.zeros(n_parts, np.uint8) if c is None else c for c in before])
        changed = ~known[:, None] | (old != codes)
        for p in range(n_parts):
            moved = changed[:, p]
            for slots, rows, sign in ((codes, moved, 1), (old, moved & known, -1)):
                np.add.at(sums[p], slots[rows, p], sign * parts[rows, p])
                np.add.at(counts[p], slots[rows, p], sign)
        if held is not None:
            yield state_batch(*held, None)
        held = batch.column(0), codes
    if held is not None:
        touched = np.argwhere((counts != 0) | (sums != 0).any(axis=2))
        yield state_batch(*held, [{"slot": int(p * n_entries + e), "n": int(counts[p, e]), "sums": sums[p, e].tolist()} for p, e in touched])


def state_batch(rows: pa.Array, codes: np.ndarray, delta: list[dict] | None) -> pa.RecordBatch:
    deltas = pa.array([delta] + [None] * (len(rows) - 1), DELTA_TYPE)
    return pa.RecordBatch.from_arrays([rows, pa.array([c.tobytes() for c in codes], pa.binary()), deltas], ["row", "code", "delta"])


def final_codes(batches: Iterator[pa.RecordBatch], codebooks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(row, ints) to (row, code in hex digits, error)."""
    for batch in batches:
        parts = matrix(batch.column(1)).reshape(-1, *codebooks.shape[::2])
        codes, far = nearest_entries(parts, codebooks)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(far.sum(axis=1), pa.int64())], ["row", "code", "error"])


def contributions(state: DataFrame, width: int) -> list:
    """slot, n and sums of all that moved in a round: a row an entry."""
    moved = state.where("delta is not null").select(F.explode("delta").alias("d")).select("d.*")
    return moved.groupBy("slot").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[j]) for j in range(width))).alias("sums")).collect()


def cut_evenly(rows: list[list[int]], n_parts: int) -> np.ndarray:
    """Codebooks (parts x entries x width) from whole vectors."""
    if len({len(r) for r in rows}) > 1 or len(rows[0]) % n_parts:
        raise ValueError(f"vectors must have one length that {n_parts} divides")
    return np.array(rows, np.int64).reshape(len(rows), n_parts, -1).transpose(1, 0, 2).copy()


def lloyd(vectors: DataFrame, buckets: Buckets, codebooks: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after ``rounds`` rounds over (row, ints), a table of ``buckets``. Ends early when no part moves, as nothing would change."""
    n_parts, n_entries, width = codebooks.shape
    sums, counts = np.zeros((n_parts * n_entries, width), np.int64), np.zeros(n_parts * n_entries, np.int64)
    state = None
    for _ in range(rounds):
        before = vectors.select("row", "ints", F.lit(None).cast("binary").alias("code")) if state is None else vectors.select("row", "ints").join(state.select("row", "code").hint("shuffle_hash"), "row")
        state = buckets.write(before.mapInArrow(partial(reassign, codebooks=codebooks), STATE), "assigned")
        moved = contributions(state, width)
        if not moved:
            break
        for m in moved:
            sums[m["slot"]] += m["sums"]
            counts[m["slot"]] += m["n"]
        used = counts > 0
        flat = codebooks.reshape(-1, width).copy()
        flat[used] = sums[used] // counts[used, None]
        codebooks = flat.reshape(codebooks.shape)
    return codebooks


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error), one row a vector that takes part, and the final codebooks (parts x entries x width; None for an empty table)."""
    spark = vectors.sparkSession
    if not 0 < entries <= 256:
        raise ValueError("entries is 1 to 256")
    bounded_batches(spark, BATCH)
    buckets = Buckets(spark)
    try:
        table = buckets.write(scaled(vectors, id_col, vector_col, label_col, scale).repartition(buckets.n, "row"), "vectors")
        first = [r["ints"] for r in table.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).select("ints").collect()]
        if not first:
            return table.selectExpr("vec_id", "label", "cast(null as string) code", "cast(null as bigint) error").where("false"), None
        codebooks = cut_evenly(first, parts)
        width = parts * codebooks.shape[2]
        if not table.where(F.size("ints") != width).isEmpty():
            raise ValueError("vectors differ in length")
        codebooks = lloyd(table, buckets, codebooks, rounds)
        coded = buckets.write(table.select("row", "ints").mapInArrow(partial(final_codes, codebooks=codebooks), "row long, code string, error long"), "codes")
        found = table.select("row", "vec_id", "label").join(coded.hint("shuffle_hash"), "row").select("vec_id", "label", "code", "error")
        return materialize(found, "vector-codes"), codebooks
    finally:
        buckets.forget()


def codebook_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def code_report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error (of all rows with that label), codebooks_sha256.

    The sums by label join their rows; Spark broadcasts them if they are small, else it splits the partitions of a label with many rows.
    """
    coded, codebooks = compress(vectors, **options)
    digest = None if codebooks is None else codebook_digest(codebooks)
    sums = coded.groupBy(F.col("label").alias("its_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("its_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))
