import random
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from millrace.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    found = {}
    sound = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    for q, x in sound:
        if q in queries:
            scored = sorted(((-(x * y).sum(), i) for i, y in sound if i != q))[:k]
            found[q] = [(i, -s) for s, i in scored]
    return found


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    made = [(i, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(900)]
    hot = [0.5] * 8
    made += [(900 + i, hot, 1) for i in range(300)]  # a vector that repeats
    odd = [None, [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0] * 5, [None] + [1.0] * 7, []]
    return made + [(2000 + i, v, 2) for i, v in enumerate(odd)] + [(None, [1.0] * 8, 3)]


def test_all_cells_give_brute_force(spark, rows):
    found = {}
    for r in A.search(spark.createDataFrame(rows, SCHEMA), lambda i: i % 100 == 0, k=7, most_centroids=8, share=1.0, part_rows=64).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    wanted = brute(rows, set(range(0, 3000, 100)), 7)
    assert set(found) == set(wanted)
    for q, hits in found.items():
        assert [i for _, i, _ in sorted(hits)] == [i for i, _ in wanted[q]]
        assert [s for *_, s in sorted(hits)] == pytest.approx([s for _, s in wanted[q]], abs=1e-12)
        assert [r for r, *_ in sorted(hits)] == list(range(1, 8))


def test_blocks_of_queries(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    whole, blocks = (sorted(map(tuple, A.search(df, lambda i: i % 100 == 0, k=7, most_centroids=8, part_rows=64, block_queries=b).collect())) for b in (20_000, 4))
    assert whole == blocks


def test_recall_of_part_of_the_cells(spark):
    """On 50,000 vectors without structure, with far fewer than half of the entries visited."""
    rng = np.random.default_rng(9)
    points = rng.normal(size=(50_000, 24)).astype(np.float32)
    folder = tempfile.mkdtemp()
    pq.write_table(pa.table({"vec_id": np.arange(50_000), "embedding": list(points)}), f"{folder}/vectors.parquet")
    vectors = spark.read.parquet(f"{folder}/vectors.parquet")
    found = {}
    for r in A.search(vectors, lambda i: i % 500 == 0, k=10).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, got in found.items():
        products = points.astype(float) @ points[q].astype(float)
        products[q] = -np.inf
        hits += len(got & set(np.argpartition(-products, 10)[:10].tolist()))
    index = A.fit(A.usable(vectors, "vec_id", "embedding"), A.centroids_for(50_000, 256), 20_000, 0.94, 10)
    print(f"recall {hits / 1000:.3f} with {index.share:.3f} of the entries")
    assert len(found) == 100 and hits >= 900 and index.share < 0.35


@pytest.mark.parametrize("step", [1, 2])
def test_cells_are_visited_in_order(step):
    rng = np.random.default_rng(0)
    index = A.MultiIndex(rng.normal(size=(6, 3)), rng.normal(size=(5, 3)), rng.integers(0, 4, (6, 5)))
    query = rng.normal(size=6)
    columns = index.columns(query[None, :])[0]
    score = (index.first @ query[:3])[:, None] + (index.second @ query[3:])[None, columns]
    for wanted in range(1, int(index.counts.sum()) + 1):
        depth = index.visited(query, wanted, step)
        best, seen = np.zeros(6, int), 0
        for r, j in sorted(((r, j) for r in range(6) for j in range(0, 5, step)), key=lambda x: -score[x]):
            if seen >= wanted:
                break
            best[r] = min(5, j + step)
            seen += index.counts[r, columns[j : j + step]].sum()
        assert (depth == best).all()


def test_parts_hold_whole_rows_or_salts():
    assert A.parts_of(np.array([3, 3, 3, 25, 1, 0, 9, 2]), 10) == [(0, 0, 1), (1, 0, 1), (2, 0, 1), (3, 1, 3), (4, 4, 1), (5, 4, 1), (6, 4, 1), (7, 5, 1)]


def test_repeated_ids_and_clashing_columns(spark):
    """Each row of an id is a query of its own and a candidate of the other."""
    rows = [(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 2), (1, [2.0, 1.0], 3)]
    vectors = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "label as part", "label as row", "label as query", "label as score", "'x' as vector")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in A.search(vectors, lambda i: i == 0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 1, 1, 2.0), (0, 2, 0, 0.0), (0, 2, 0, 0.0)]


def test_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [2.0, 1.0], 0), (2, [2.0, 1.0], 0)], SCHEMA)
    assert [(r["rank"], r.vec_id, r.score) for r in A.search(few, lambda i: i == 0).collect()] == [(1, 1, 4.0), (2, 2, 4.0)]
    assert A.search(few.where("false"), lambda i: i == 0).collect() == []
    assert A.search(few.where("vec_id = 0"), lambda i: i == 0).collect() == []
