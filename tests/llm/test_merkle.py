import hashlib
import zlib
from itertools import groupby

import pytest
from fixtures import DOCS, clashing, documents, hard_documents
from pyspark.sql import functions as F

from millrace.llm import merkle as M


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def levels_of(nodes, fanout):
    """All levels of a tree, each by the definition."""
    found = [nodes]
    while len(nodes) > 1:
        nodes = [digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        found.append(nodes)
    return found


def path(levels, place, fanout):
    """(run, place in it) of each level below the root."""
    found = []
    for nodes in levels[:-1]:
        first = place - place % fanout
        found.append((nodes[first : first + fanout], place - first))
        place //= fanout
    return found


def brute_force(rows, fanout=3):
    order = lambda r: (r[3] is not None, (r[3] or "").encode())
    by_source = [(s, sorted(((r[0] is not None, r[0] or 0, leaf(r)), r) for r in g)) for s, g in groupby(sorted(rows, key=order), key=lambda r: r[3])]
    trees = [levels_of([k[2] for k, _ in g], fanout) for _, g in by_source]
    top = levels_of([t[-1][0] for t in trees], fanout)
    out = []
    for s, (_, group) in enumerate(by_source):
        for place, (key, row) in enumerate(group):
            steps = path(trees[s], place, fanout) + path(top, s, fanout)
            proof = digest("".join(x for run, at in steps for i, x in enumerate(run) if i != at))
            node = key[2]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[1] is not None:
                node = leaf((row[0], row[1].replace("\n", ""), *row[2:]))
            for run, at in steps:
                node = digest("".join(node if i == at else x for i, x in enumerate(run)))
            out.append((row[0], key[2], trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def report(df, **options):
    return sorted(map(tuple, M.manifest(df, M.newlines_deleted(F.col("doc_id"), F.col("text")), **options).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    made = [(1000 + i, f"line {i}\nline {i % 7}\n" * (i % 3), "en", f"s{i % 5 if i % 3 else 9}", i) for i in range(120)]
    return hard_documents() + made + [(None, "no id\n", None, None, None), (None, "no id\n", None, None, None), (None, None, "de", "a", 3), (7, "é\n", "de", "ü", 2)]


@pytest.mark.parametrize("fanout,levels", [(3, 7), (3, 1), (3, 2), (2, 3)])
def test_manifest(spark, rows, fanout, levels):
    df = clashing(spark.createDataFrame(rows, DOCS)).withColumn("tree", F.lit("x")).withColumn("idx", F.lit(0)).repartition(5)
    found = report(df, fanout=fanout, levels=levels)
    assert found == brute_force(rows, fanout)
    assert {r[6] for r in found} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 82])
def test_sizes_around_full_buckets(spark, n):
    rows = [(i, f"t{i}\n", "en", "only", 2) for i in range(n)]
    assert report(spark.createDataFrame(rows, DOCS), levels=2) == brute_force(rows)


def test_no_rows_and_bad_parameters(spark):
    none = M.manifest(documents(spark).where("false"))
    assert none.collect() == [] and none.columns == [c.split()[0] for c in M.RESULT.split(", ")]
    with pytest.raises(ValueError):
        M.manifest(documents(spark), fanout=1)


def test_untampered_rows_verify(spark):
    assert all(r.verified and r.folded_root == r.root for r in M.manifest(documents(spark)).collect())


def test_a_bucket_holds_no_more_than_its_share(spark):
    leaves = M.indexed(M.dataset_leaves(spark.createDataFrame([(i, "t", "en", "hot" if i % 3 else f"s{i}", 1) for i in range(300)], DOCS)), ["doc_id", "node"])
    places = leaves.groupBy("tree").agg(F.min("idx").alias("low"), F.max("idx").alias("high"), F.count("*").alias("n"), F.countDistinct("idx").alias("d")).collect()
    assert all(p.low == 0 and p.high == p.n - 1 and p.d == p.n for p in places)
    passes, roots = M.reduced(leaves, 3, 2)
    assert len(passes) == 3 and passes[0].groupBy("tree", "bucket").count().agg(F.max("count")).first()[0] == 9
    assert roots.count() == 101
