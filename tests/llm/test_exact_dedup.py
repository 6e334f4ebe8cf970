import hashlib
from collections import defaultdict

import pytest
from fixtures import DOCS, clashing, documents, hard_documents

from millrace.llm import exact_dedup as E

FOLD = {i: i + 32 for i in range(65, 91)}


def digest(text):
    return hashlib.sha256((text or "").translate(FOLD).encode()).hexdigest()


def groups(rows):
    found = defaultdict(list)
    for d, t, *_ in rows:
        found[digest(t)].append(d)
    return found


@pytest.mark.parametrize("tracked", [4096, 8])
def test_groups(spark, tracked):
    rows = hard_documents() + [(5000 + i, "hot text", "en", "a", 8) for i in range(150)]
    found = E.exact_groups(spark.createDataFrame(rows, DOCS), heavy=4, tracked=tracked).collect()
    by = groups(rows)
    assert sorted((r.doc_id, r.text_sha256) for r in found) == sorted((d, digest(t)) for d, t, *_ in rows)
    for r in found:
        ids = by[r.text_sha256]
        assert r.keep_id == max(ids) and r.group_size == len(ids)
    assert sorted(r.text_sha256 for r in found if r.kept) == sorted(by)  # one row of each group
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_heavy_hitters_are_verified(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"t{i}", "en", "a", 0) for i in range(400)], DOCS)
    marked = rows.selectExpr("doc_id", "sha2(cast(text as binary), 256) AS text_sha256", "doc_id AS tag")
    heavy = E.heavy_digests(marked, 4, 16).collect()
    assert [(r.text_sha256, r.group_size, r.best.doc_id) for r in heavy] == [(digest("hot"), 200, 399)]


def test_deduplicate(spark):
    df = clashing(documents(spark))
    kept = E.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((digest(r.text), r.doc_id) for r in kept.collect()) == sorted((k, max(v)) for k, v in groups(hard_documents()).items())


def test_null_ids_and_empty(spark):
    rows = [(None, "a", "", "", 0), (None, "A", "", "", 0), (None, "b", "", "", 0), (3, "b", "", "", 0)]
    found = E.exact_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.keep_id or 0, r.group_size, r.kept) for r in found) == [(0, 2, False), (0, 2, True), (3, 2, False), (3, 2, True)]
    assert E.exact_groups(documents(spark).where("false")).collect() == [] and E.deduplicate(documents(spark).where("false")).collect() == []
    assert len(E.deduplicate(spark.createDataFrame(rows, DOCS)).collect()) == 2


def test_main_path_is_native(spark):
    plan = E.exact_groups(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
