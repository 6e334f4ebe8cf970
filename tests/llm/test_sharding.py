import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from fixtures import DOCS, clashing, documents, hard_documents

from millrace.llm import sharding as S


@pytest.mark.parametrize("dims,bits", [(2, 2), (2, 4), (3, 2), (3, 4), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    order = {r.curve: r.cell for r in S.hilbert_curve(spark, dims, bits).collect()}
    assert sorted(order) == list(range(1 << dims * bits)) == sorted(order.values())
    steps = [[(order[k] >> bits * d) & ((1 << bits) - 1) for d in range(dims)] for k in range(len(order))]
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in zip(steps, steps[1:]))


def test_grid_is_bounded(spark):
    with pytest.raises(ValueError):
        S.hilbert_curve(spark, 5, 4)


@pytest.mark.parametrize("build", [documents, lambda s: clashing(documents(s))])
def test_shards(spark, build):
    rows, given = S.shard_documents(build(spark)).collect(), hard_documents()
    data = lambda t: (t or "").encode()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((d, len(data(t)) + 1, zlib.crc32(data(t))) for d, t, *_ in given)
    by = {k: [r for r in rows if r.shard == k] for k in range(8)}
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1 and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    runs = [[r.curve for r in by[k]] for k in range(8)]
    assert all(max(a) <= min(b) for a, b in zip(runs, runs[1:]))


def test_written_shards_keep_the_rows(spark, tmp_path):
    docs = clashing(documents(spark)).selectExpr("*", "1 as shard")
    rows = S.write_shards(docs, f"{tmp_path}/shards")
    assert rows.columns == [*docs.columns, "slot", "curve", "shard_"]
    assert sorted(map(str, rows.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert sorted(p.name for p in (tmp_path / "shards").glob("shard_=*")) == [f"shard_={i}" for i in range(8)]
    for path in (tmp_path / "shards").glob("shard_=*/*.parquet"):
        slots = [r.slot for r in spark.read.parquet(str(path)).collect()]
        assert slots == sorted(slots)


def test_files_are_pruned_in_each_dimension(spark, tmp_path):
    """A filter on any one dimension leaves most files out: on sizes by the ranges in the footers, on categories by the dictionaries."""
    rng = random.Random(6)
    rows = [(i, "t", rng.choice("abcdefgh"), f"s{rng.randrange(8)}", int(2 ** rng.uniform(0, 14))) for i in range(8000)]
    docs = spark.createDataFrame(rows, DOCS)
    S.write_shards(docs, f"{tmp_path}/curve", shards=64)
    docs.repartition(64).write.parquet(f"{tmp_path}/plain")

    def share_read(folder, column, values):
        hit = []
        for path in (tmp_path / folder).glob("**/*.parquet"):
            held = pq.ParquetFile(path).read([column]).column(column).unique().to_pylist()
            hit += [min(held) <= v <= max(held) if column == "n_chars" else v in held for v in values]
        return np.mean(hit)

    for column, values in (("n_chars", [1, 30, 700, 9000]), ("lang", list("abcdefgh")), ("source", [f"s{k}" for k in range(8)])):
        assert share_read("curve", column, values) < 0.5 < 0.95 < share_read("plain", column, values)


def test_few_and_no_rows(spark):
    assert S.shard_documents(documents(spark).where("false")).count() == 0
    assert S.shard_documents(documents(spark, hard_documents()[:3])).count() == 3


def test_main_path_is_native(spark):
    plan = S.shard_documents(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
