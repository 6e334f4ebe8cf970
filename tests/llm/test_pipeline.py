"""The pipeline's stages against brute force on hard documents; its registered queries import without the subpackage."""

import random
import subprocess
import sys
from pathlib import Path

import pytest
from fixtures import DOCS, clashing, hard_documents, sentence
from test_exact_dedup import groups
from test_ngram_join import brute as components
from test_substring_dedup import brute as without

import corpus_pipeline
from millrace.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [r for r in hard_documents() if r[0] is not None]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_are_the_named_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "substring_dedup", "packing"]


def test_stages(spark, folder):
    given = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    last = {max(ids): None for ids in groups(given).values()}
    exact = list({r[0]: r for r in given if r[0] in last}.values())
    one = components(exact)
    near = [r for r in exact if one[r[0]][1] == r[0]]
    cut = {d: (n - gone) for d, n, gone, _ in without(near)}
    docs, columns = spark.read.parquet(f"{folder}/documents.parquet"), [c.split()[0] for c in DOCS.split(", ")]
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        assert docs.columns == columns
        seen.append(sorted(r.doc_id for r in docs.collect()))
    assert seen == [sorted(r[0] for r in given), sorted(r[0] for r in exact), sorted(r[0] for r in near), sorted(cut)]
    assert {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()} == cut
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == set(cut)
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, folder).collect()) == sorted(tuple(r)[:5] for r in packed)


def test_clashing_names(spark, folder, tmp_path):
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    wide = clashing(plain)
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == wide.columns
        assert {tuple(r[n] for n in wide.columns[5:]) for r in docs.collect()} == {tuple(range(len(wide.columns) - 5))}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(tuple(r)[:5] for r in packed) == sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, folder).collect())


def test_toxic_rows_go(spark, tmp_path):
    """Half of the rows are labelled, half of those toxic by two words; the words tell on rows that aren't labelled, too."""
    rng = random.Random(9)
    bad = lambda i: i % 2 == 0
    texts = [f"{sentence(rng, 20, 5000)} {'vile scum' if bad(i) else 'kind folk'} {sentence(rng, 20, 5000)}" for i in range(240)]
    spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(bad(i))) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i for i in range(240) if not bad(i)} <= left and not any(bad(i) for i in left)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        assert (docs.columns, docs.count()) == ([c.split()[0] for c in DOCS.split(", ")], 0)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_rest_imports_without_the_subpackage(tmp_path):
    repo = Path(corpus_pipeline.__file__).parent
    code = f"import sys; sys.path.insert(0, {str(repo)!r}); sys.modules['millrace.llm'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and 'import_ranking_top10' in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True).returncode == 0
