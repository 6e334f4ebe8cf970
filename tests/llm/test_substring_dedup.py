import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from fixtures import DOCS, clashing, documents, hard_documents, sentence

from millrace.llm import substring_dedup as S
from millrace.llm.shingles import word_hashes


def brute(rows, window=50):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    for d, words in split:
        for i in range(len(words) - window + 1):
            if d is not None:
                key = tuple(words[i : i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, words in split:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if d is not None and first[tuple(words[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [w.decode() for w, g in zip(words, gone) if not g]
        out.append((d, len(words), sum(gone), " ".join(kept)))
    return sorted(out, key=str)


def found(df, **options):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in S.remove_repeats(df, **options).collect()], key=str)


def test_hard_documents(spark):
    assert found(documents(spark)) == brute(hard_documents())
    assert found(clashing(documents(spark))) == brute(hard_documents())


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 36])
def test_smallest_places(width):
    rng = np.random.default_rng(width)
    for n in (width, width + 1, 200):
        values = rng.integers(0, 5, n).astype(np.uint64)
        assert S.smallest_places(values, width).tolist() == [i + int(values[i : i + width].argmin()) for i in range(n - width + 1)]


def test_a_very_long_text_takes_memory_in_proportion():
    words = np.random.default_rng(2).integers(0, 50_000, 500_000).astype(np.uint64)
    tracemalloc.start()
    S.segments_of(words, 50, 15)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 * words.nbytes


def test_small_alphabet_and_null_ids(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(30)]), " ".join(rng.choices("ab", k=rng.randrange(0, 40))), "", "", 0) for _ in range(80)]
    df = spark.createDataFrame(rows, DOCS)
    assert found(df, window=6, anchor=3) == brute(rows, 6)
    assert found(df, window=5, anchor=1) == brute(rows, 5)


def test_split_anchor(spark, monkeypatch):
    """An anchor with many distinct segments goes to several shards with the same result."""
    rng = random.Random(3)
    core = sentence(rng, 30)
    rows = [(i, f"{sentence(rng, 15)} {core} {sentence(rng, 15, 6)}", "", "", 0) for i in range(60)] + [(99, sentence(rng, 15) + " " + core, "", "", 0)]
    rows += [(200 + i, t, "", "", 0) for i, (_, t, *_) in enumerate(rows[:20])]
    monkeypatch.setattr(S, "SHARD_SEGMENTS", 3)
    assert found(spark.createDataFrame(rows, DOCS), window=20, anchor=6) == brute(rows, 20)


def test_window_in_many_segments_is_indexed_once(spark, monkeypatch):
    """Windows that many different segments share reach a shard as one piece, and the result is the same."""
    rng = random.Random(4)
    core = sentence(rng, 24)
    rows = [(i, f"{sentence(rng, 12)} {core} {sentence(rng, 12)}", "", "", 0) for i in range(80)]
    monkeypatch.setattr(S, "SHARD_SEGMENTS", 5)
    monkeypatch.setattr(S, "INDEX_WORDS", 400)
    seen, plain = [], S.materialize

    def spy(df, label):
        out = plain(df, label)
        if label in ("pieces", "found-runs"):
            seen.append(out)
        return out

    monkeypatch.setattr(S, "materialize", spy)
    assert found(spark.createDataFrame(rows, DOCS), window=20, anchor=6) == brute(rows, 20)
    pieces, runs = seen
    hottest = pieces.where("split").groupBy("shard", "piece").count().orderBy("count", ascending=False).first()
    assert hottest["count"] >= 60
    assert runs.where("split").where(f"piece = {hottest['piece']}").count() == 1


@pytest.mark.parametrize("window", [1, 2, 12, 16])
def test_backward_search_finds_all_windows(window):
    """Of the indexed sequences, and of others that share some, or no, windows and words with them."""
    rng = random.Random(window)
    texts = [[rng.choice("abc").encode() for _ in range(rng.randrange(12, 60))] for _ in range(40)]
    others = [[rng.choice("abcd").encode() for _ in range(rng.randrange(0, 60))] for _ in range(40)]
    others += [x[5:35] + rng.choice([[b"d"], [b"a", b"a"], []]) + y[3:40] for x, y in zip(texts, texts[1:])] + [[b"e"] * 30]
    ids = np.arange(40)[::-1].copy()
    index = S.ShardIndex([word_hashes(t) for t in texts], ids, window)
    first = {}
    for t, d in zip(texts, ids):
        for i in range(len(t) - window + 1):
            first[tuple(t[i : i + window])] = min(first.get(tuple(t[i : i + window]), 99), int(d))
    hits = 0
    for t, places in zip(texts + others, index.earliest_documents([word_hashes(t) for t in texts + others])):
        wanted = [first.get(tuple(t[i : i + window]), -1) for i in range(len(t) - window + 1)]
        assert [int(index.documents[p]) if p >= 0 else -1 for p in places] == wanted
        hits += sum(w >= 0 for w in wanted) if t in others else 0
    assert hits > 100


def test_result_comes_from_the_search(spark, monkeypatch):
    """Only documents that are streamed against the index of earlier ones lose windows."""
    rng = random.Random(8)
    core = sentence(rng, 30)
    rows = [(i, f"{sentence(rng, 15)} {core} {sentence(rng, 15)}", "", "", 0) for i in range(5)]
    assert found(spark.createDataFrame(rows, DOCS), window=20, anchor=6) == brute(rows, 20)
    batch = S.batch_of(list(zip(*[(7, d, False, len(t.split()) - 19, d, t.encode()) for d, t, *_ in rows])), "shard long, piece long, split boolean, count int, doc_id long, words binary")

    def runs():
        return [r for out in S.search_shards(iter([batch]), 20) for r in out.to_pylist()]

    assert all(any(r["piece"] == d and r["earliest"] == 0 for r in runs()) for d in range(5))
    monkeypatch.setattr(S.ShardIndex, "earliest_documents", lambda self, streamed: [np.full(max(0, len(s) - 19), -1) for s in streamed])
    assert all(r["earliest"] == r["piece"] for r in runs())


def test_segments_with_one_hash_are_told_apart_by_their_anchors(spark, monkeypatch):
    """Hashes of few bits: many of the corpus's segments share one, but none of those with one anchor do."""
    rng = random.Random(31)
    passages = [sentence(rng, 25, 5000) for _ in range(150)]
    rows = [(i, " ".join(rng.sample(passages, 6)), "", "", 0) for i in range(60)]
    plain, hashes, few = S.find_anchors, set(), (1 << 14) - 1

    def short_hashes(batches, window, anchor):
        for batch in plain(batches, window, anchor):
            at = batch.schema.get_field_index("segment")
            yield batch.set_column(at, "segment", pa.array([x & few for x in batch.column(at).to_pylist()], pa.int64()))

    for _, text, *_ in rows:
        a, s, _, _ = S.segments_of(word_hashes(text.encode().split()), 20, 6)
        hashes |= set(zip(a.tolist(), s.tolist()))
    assert len({(a, s & few) for a, s in hashes}) == len(hashes) > len({s & few for _, s in hashes}) + 10
    monkeypatch.setattr(S, "find_anchors", short_hashes)
    assert found(spark.createDataFrame(rows, DOCS), window=20, anchor=6) == brute(rows, 20)


def test_wavelet_ranks():
    rng = np.random.default_rng(2)
    symbols = rng.integers(0, 300, 1000)
    matrix = S.WaveletMatrix(symbols, 9)
    for s in (0, 1, 77, 299):
        at = np.arange(1001)
        rank = matrix.place(np.full(1001, s), at) - matrix.place(np.full(1001, s), np.zeros(1001, np.int64))
        assert rank.tolist() == [0, *np.cumsum(symbols == s).tolist()]


def test_stage(spark):
    df = clashing(documents(spark))
    kept = S.without_repeats(df)
    assert kept.columns == df.columns and dict(kept.dtypes)["n_chars"] == "bigint"
    given, wanted = hard_documents(), brute(hard_documents())
    rows = kept.collect()
    assert sorted(((r.doc_id, len((r.text or "").encode().split())) for r in rows), key=str) == sorted(((d, n - g) for d, n, g, _ in wanted), key=str)
    untouched = {d for d, _, g, _ in wanted if not g} - {d for d, _, g, _ in wanted if g}
    assert {(r.doc_id, r.text) for r in rows if r.doc_id in untouched} == {(d, t) for d, t, *_ in given if d in untouched}
    assert S.remove_repeats(documents(spark).where("false")).collect() == []


@pytest.mark.parametrize("n", [49, 50, 51])
def test_borders(spark, n):
    text = sentence(random.Random(n), n)
    rows = [(2, text, "", "", 0), (1, text, "", "", 0)]
    assert found(spark.createDataFrame(rows, DOCS)) == brute(rows)
