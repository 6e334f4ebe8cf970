import math
import random
from collections import defaultdict

import numpy as np
import pytest
from fixtures import clashing
from pyspark.sql import functions as F

from millrace.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def made(n=150, dims=16, seed=4):
    rng = random.Random(seed)
    rows = [(i * 7 % 1009, [rng.uniform(-1, 1) for _ in range(dims)], rng.choice([1, 2, None])) for i in range(n)]
    rows += [(2000 + i, [0.5] * dims, 9) for i in range(60)]  # one vector that repeats
    rows += [(3000, None, 1), (3001, [], 1), (3002, [math.nan] * dims, 1), (3003, [math.inf] * dims, 2), (3004, [None] + [0.0] * (dims - 1), 2), (None, [0.25] * dims, None), rows[3]]
    return rows


def brute_force(rows, n_parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // n_parts
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[list(part(v, p)) for _, v, _ in kept[:entries]] for p in range(n_parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(v, p), c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        gathered = defaultdict(list)
        for _, v, _ in kept:
            for p in range(n_parts):
                gathered[p, nearest(v, p)[1]].append(part(v, p))
        for (p, e), vs in gathered.items():
            books[p][e] = [sum(c) // len(vs) for c in zip(*vs)]
    found = []
    for i, v, y in kept:
        best = [nearest(v, p) for p in range(n_parts)]
        found.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), y))
    total = defaultdict(int)
    for _, _, e, y in found:
        total[y] += e
    import hashlib

    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, total[y], digest) for i, c, e, y in found), key=str)


def report(df, **options):
    return sorted(map(tuple, V.code_report(df, **options).collect()), key=str)


@pytest.mark.parametrize("partitions", [1, 5])
def test_codes(spark, partitions):
    rows = made()
    df = clashing(spark.createDataFrame(rows, SCHEMA)).withColumn("code", F.lit(1)).withColumn("its_label", F.lit(2)).repartition(partitions)
    assert report(df) == brute_force(rows)


@pytest.mark.parametrize("n", [1, 5])
def test_fewer_vectors_than_entries(spark, n):
    rows = made()[:n]
    assert report(spark.createDataFrame(rows, SCHEMA)) == brute_force(rows)
    assert report(spark.createDataFrame(rows, SCHEMA), rounds=0) == brute_force(rows, rounds=0)


def test_empty_and_unfit(spark):
    df = spark.createDataFrame(made(5), SCHEMA)
    assert report(df.where("false")) == [] and report(df.where("embedding is null")) == []
    with pytest.raises(ValueError, match="differ"):
        V.code_report(spark.createDataFrame([(1, [0.0] * 16, 1)] + [(2 + i, [0.0] * (24 if i == 29 else 16), 1) for i in range(30)], SCHEMA))
    with pytest.raises(ValueError, match="divides"):
        V.code_report(spark.createDataFrame([(1, [0.0] * 15, 1)], SCHEMA))
    with pytest.raises(Exception, match="component beyond"):
        V.code_report(spark.createDataFrame([(1, [1e30] * 16, 1)], SCHEMA))


def test_rounds_move_only_changed_parts(spark):
    """Running sums kept by contributions equal sums over all parts, and late contributions are fewer; joins of rounds shuffle nothing."""
    buckets = V.Buckets(spark)
    table = buckets.write(V.scaled(spark.createDataFrame(made(), SCHEMA), "vec_id", "embedding", "label", 4096).repartition(buckets.n, "row"), "vectors")
    books = V.cut_evenly([r.ints for r in table.orderBy("vec_id").limit(16).collect()], 8)
    moved = []
    sums, counts, state = np.zeros((128, 2), np.int64), np.zeros(128, np.int64), None
    for _ in range(3):
        before = table.select("row", "ints", F.lit(None).cast("binary").alias("code")) if state is None else table.select("row", "ints").join(state.select("row", "code").hint("shuffle_hash"), "row")
        if state is not None:
            assert "Exchange" not in before._jdf.queryExecution().executedPlan().toString()
        state = buckets.write(before.mapInArrow(lambda b, c=books: V.reassign(b, c), V.STATE), "assigned")
        rows = V.contributions(state, 2)
        for r in rows:
            sums[r.slot] += r.sums
            counts[r.slot] += r.n
        codes = {r.row: r.code for r in state.collect()}
        for slot in range(128):
            mine = [r.ints[slot // 16 * 2 : slot // 16 * 2 + 2] for r in table.collect() if codes[r.row][slot // 16] == slot % 16]
            assert counts[slot] == len(mine) and sums[slot].tolist() == [sum(c) for c in zip(*mine)] + [0, 0][: 0 if mine else 2]
        moved.append(sum(abs(r.n) for r in rows))
        flat = books.reshape(-1, 2).copy()
        flat[counts > 0] = sums[counts > 0] // counts[counts > 0, None]
        books = flat.reshape(books.shape)
    assert moved[1] < moved[0] / 2 and moved[2] < moved[0] / 2
    buckets.forget()
    assert not any(spark.catalog.tableExists(n) for n in buckets.names)


def test_ties_go_to_the_lower_entry():
    codes, far = V.nearest_entries(np.array([[[0, 0]], [[2, 0]]]), np.array([[[1, 0], [-1, 0], [1, 0]]]))
    assert codes.tolist() == [[0], [0]] and far.tolist() == [[1], [1]]
