"""Inner-product search with an inverted multi-index.

Each vector is cut into two halves and each half is assigned to the nearest centroid of its own codebook, so
K centroids a half make K x K cells; K grows with the square root of the number of vectors, up to ``most_centroids``. For a query, centroid
pairs are visited in order of the sum of their two inner products with the query's halves: a heap holds, for each first centroid, the
best second one that is left, and a visit takes a short run of them. It ends when the visited cells hold enough entries; those
entries are reranked by exact inner product with the original vectors.

How many are enough is measured: brute force over the sample that the codebooks are fitted on tells which share of the entries, in
order of visit, holds ``recall`` of the nearest ones. A larger table needs a smaller share, so this one errs on the safe side.

The sample is bounded (``sample_rows`` vectors, chosen by a hash of the id); every vector is indexed. Entries are dealt to parts of about
``part_rows``: whole first centroids, or a salt of one that holds more, so neither a large cell nor a vector that repeats a million
times meets in one task. A task holds the entries of one part and streams the queries that visit it. Queries are dealt to blocks
of about ``block_queries``, so a task's work is bounded; entries are copied for each block, of which tables of up to 20 x ``block_queries`` vectors have one. The best ``k`` of
each part are merged by query row. No cell is capped. The work grows as queries x share x entries.

Vectors that are null, zero, of another length than the index, or hold a null or non-finite component take no
part, neither as queries nor as candidates. Ties go to the smaller id. With fewer than ``k`` candidates all
are returned; an empty table gives no rows. Rows that repeat an id are rows of their own: each is a query with a ranking of its own, and a
candidate of the other. Only the id and vector columns are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import bounded_batches, materialize

BATCH = 2048
#: Queries that are scored against a part's entries at a time.
QUERIES = 128
FOUND = "query_row long, query_id long, vec_id long, score double"


@dataclass
class MultiIndex:
    """Two codebooks (K x half), the number of entries of each cell (K x K), and the share of entries to visit: a fixed size."""

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray
    share: float = 1.0

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return vectors[:, :cut], vectors[:, cut:]

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.halves(vectors)
        return nearest(a, self.first), nearest(b, self.second)

    def columns(self, queries: np.ndarray) -> np.ndarray:
        """Second centroids of each query, best first."""
        return np.argsort(-(self.halves(queries)[1] @ self.second.T), axis=1, kind="stable")

    def visited(self, query: np.ndarray, wanted: float, step: int = 1) -> np.ndarray:
        """For each first centroid how many second ones, best first, are visited until the cells hold ``wanted`` entries. A visit takes ``step`` of them."""
        a, b = self.halves(query[None, :])
        left, right = self.first @ a[0], self.second @ b[0]
        order = np.argsort(-right, kind="stable")
        right = right[order]
        held = np.cumsum(self.counts[:, order], axis=1)
        depth, last, seen = [0] * len(left), len(right), 0
        heap = sorted((-(x + right[0]), i) for i, x in enumerate(left.tolist()))
        left, right = left.tolist(), right.tolist()
        while heap and seen < wanted:
            i = heap[0][1]
            j = depth[i]
            end = min(last, j + step)
            seen += int(held[i, end - 1] - (held[i, j - 1] if j else 0))
            depth[i] = end
            if end < last:
                heapq.heapreplace(heap, (-(left[i] + right[end]), i))
            else:
                heapq.heappop(heap)
        return np.array(depth)


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points @ centroids.T - (centroids**2).sum(axis=1) / 2).argmax(axis=1)


def k_means(points: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    points = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centroids = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(points, centroids)
        size = np.bincount(own, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, own, points)
        centroids[size > 0] = total[size > 0] / size[size > 0, None]
    return centroids


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part; all have the most frequent length (ties: the longer)."""
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null")
    sound = "forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0)"
    v = v.where(sound)
    length = v.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return v.where(F.size("vector") == (length[0]["n"] if length else 0))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def centroids_for(n: int, most: int) -> int:
    """About the square root of the number of vectors, a power of two."""
    return int(min(most, max(4, 2 ** round(np.log2(np.sqrt(max(1, n)) * 1.2)))))


def share_for(points: np.ndarray, index: MultiIndex, recall: float, k: int, queries: int = 256) -> float:
    """The share of the entries, in order of their cells' sums, that holds ``recall`` of the nearest ones of some sampled vectors."""
    asked = np.linspace(0, len(points) - 1, min(queries, len(points))).astype(int)
    if len(points) <= k + 1:
        return 1.0
    row, column = index.cells(points)
    shares = []
    for q in asked:
        exact = points @ points[q]
        exact[q] = -np.inf
        a, b = index.halves(points[q][None, :])
        sums = (index.first @ a[0])[row] + (index.second @ b[0])[column]
        ranked = np.sort(-sums)
        shares.append(np.searchsorted(ranked, -sums[np.argpartition(-exact, k)[:k]], side="right") / len(points))
    return float(np.quantile(np.concatenate(shares), recall))


def fit(vectors: DataFrame, centroids: int, sample_rows: int, recall: float, k: int) -> MultiIndex | None:
    """Codebooks and share from a bounded sample; counts are still zero."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
    if sample.empty:
        return None
    points = matrix(sample["vector"])
    cut = (points.shape[1] + 1) // 2
    first, second = k_means(points[:, :cut], centroids), k_means(points[:, cut:], centroids)
    index = MultiIndex(first, second, np.zeros((len(first), len(second)), np.int64))
    index.share = share_for(points, index, recall, k)
    return index


def parts_of(by_row: np.ndarray, part_rows: int) -> list[tuple[int, int, int]]:
    """row, part, salts: consecutive first centroids share a part, one with more entries than that has several of its own."""
    out, part, held = [], 0, 0
    for row, n in enumerate(by_row.tolist()):
        salts = max(1, -(-n // part_rows))
        if held and (salts > 1 or held + n > part_rows):
            part, held = part + 1, 0
        out.append((row, part, salts))
        held += n
        if salts > 1:
            part, held = part + salts, 0
    return out


def rows_of(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def best_of_part(batches: Iterator[pa.RecordBatch], shared, k: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` of its part for each query and part, as FOUND. Rows come sorted by part, entries before queries."""
    index, at, held, entries = shared.value, None, [], None

    def answer(batch: pa.RecordBatch) -> pa.RecordBatch:
        points, row_ids, ids, row, column = entries
        near, own = rows_of(batch.column("vector")), batch.column("row_id").to_numpy()
        depth = np.stack([np.frombuffer(x, np.uint16) for x in batch.column("depths").to_pylist()])
        place = np.empty((len(near), len(index.second)), np.uint16)
        np.put_along_axis(place, index.columns(near), np.arange(len(index.second), dtype=np.uint16)[None, :], axis=1)
        products = near @ points.T
        products[place[:, column] >= depth[:, row]] = -np.inf
        products[own[:, None] == row_ids[None, :]] = -np.inf
        edge = -np.partition(-products, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
        out = []
        for q in range(len(near)):
            # products of a block may differ in the last bits from those of a single pair
            close = np.flatnonzero((products[q] > -np.inf) & (products[q] >= edge[q] - 1e-9 * (1 + abs(edge[q]))))
            score = (points[close] * near[q]).sum(axis=1)
            first = np.lexsort((ids[close], -score))[:k]
            out.append((np.full(len(first), q), ids[close][first], score[first]))
        which = np.concatenate([x[0] for x in out])
        columns = [own[which], batch.column("vec_id").to_numpy()[which], np.concatenate([x[1] for x in out]), np.concatenate([x[2] for x in out])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in FOUND.split(", ")])

    for batch in batches:
        part, query = batch.column("part").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(part) != 0) | (np.diff(query) != 0)) + 1
        for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(part)]):
            if low == high:
                continue
            if part[low] != at:
                at, held, entries = part[low], [], None
            piece = batch.slice(low, high - low)
            if not query[low]:
                held.append((rows_of(piece.column("vector")), *(piece.column(c).to_numpy() for c in ("row_id", "vec_id", "row", "col"))))
                continue
            if entries is None and held:
                entries = tuple(np.concatenate(x) for x in zip(*held))
            for start in range(0, len(piece) if entries else 0, QUERIES):
                yield answer(piece.slice(start, QUERIES))


def search(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    recall: float = 0.94,
    most_centroids: int = 256,
    sample_rows: int = 20_000,
    part_rows: int = 4_096,
    block_queries: int = 20_000,
    share: float | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score of each query row's ``k`` nearest found. A query visits cells until they hold
    ``share`` of all entries; where that isn't given, it is measured for ``recall``."""
    spark = vectors.sparkSession
    bounded_batches(spark, BATCH)
    rows = usable(vectors, id_col, vector_col)
    index = fit(rows, centroids_for(rows.count(), most_centroids), sample_rows, recall, k)
    schema = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf("struct<row int, col int>")
    def cell(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            row, column = shared.value.cells(matrix(batch)) if len(batch) else ([], [])
            yield pd.DataFrame({"row": np.asarray(row, "int32"), "col": np.asarray(column, "int32")})

    placed = rows.withColumn("cell", cell("vector")).select(F.monotonically_increasing_id().alias("row_id"), "vec_id", "vector", "cell.row", "cell.col")
    entries = materialize(placed, "entries")
    for row, col, n in entries.groupBy("row", "col").count().collect():  # at most most_centroids^2 rows
        index.counts[row, col] = n
    counted = spark.sparkContext.broadcast(index)
    wanted, step = index.counts.sum() * (index.share if share is None else share), max(1, len(index.second) // 32)
    parts = parts_of(index.counts.sum(axis=1), part_rows)
    first, salts = np.array([p[1] for p in parts]), np.array([p[2] for p in parts])

    @F.pandas_udf("struct<parts array<int>, depths binary>")
    def visits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for query in map(np.asarray, batch):
                depth = counted.value.visited(query, wanted, step)
                met = sorted({p for a, n in zip(first[depth > 0].tolist(), salts[depth > 0].tolist()) for p in range(a, a + n)})
                out.append((met, depth.astype(np.uint16).tobytes()))
            yield pd.DataFrame(out, columns=["parts", "depths"])

    dealt = F.broadcast(spark.createDataFrame(parts, "row int, first int, salts int"))
    chosen = entries.where(is_query(F.col("vec_id")))
    blocks = -(-chosen.count() // block_queries) or 1
    held = entries.join(dealt, "row").withColumn("part", F.expr("first + pmod(xxhash64(row_id), salts)"))
    held = held.withColumn("part", F.explode(F.sequence(F.col("part") * blocks, F.col("part") * blocks + (blocks - 1))))
    held = held.select("part", F.lit(False).alias("query"), "row_id", "vec_id", "vector", "row", "col", F.lit(None).cast("binary").alias("depths"))
    block = F.pmod(F.xxhash64(F.col("row_id"), F.lit(1)), F.lit(blocks))
    asked = chosen.withColumn("visit", visits("vector")).withColumn("part", F.explode("visit.parts"))
    asked = asked.select((F.col("part") * blocks + block).alias("part"), F.lit(True).alias("query"), "row_id", "vec_id", "vector", "row", "col", "visit.depths")
    both = held.unionByName(asked).repartition("part").sortWithinPartitions("part", "query")
    found = both.mapInArrow(partial(best_of_part, shared=counted, k=k), FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
