import random

import numpy as np
import pyarrow as pa
import pytest
from fixtures import DOCS, clashing, documents, hard_documents, sentence

from millrace.llm import ngram_join as J
from millrace.llm.shingles import mix, shingle_set, split_words


def brute(rows, width=5, percent=80):
    """Component and set size by doc_id, from real shingles and all pairs."""
    sets = {}
    for doc_id, text, *_ in rows:
        words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()]
        n = min(width, len(words))
        sets[doc_id] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def found(spark, rows, **options):
    df = J.ngram_components(spark.createDataFrame(rows, DOCS), **options).collect()
    assert len(df) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df}


def test_hard_documents(spark):
    assert found(spark, hard_documents()) == brute(hard_documents())


def test_chains_and_borders(spark):
    """Texts that drift: neighbours link, ends don't; many pairs lie near the threshold."""
    rng = random.Random(8)
    rows, words = [], sentence(rng, 60).split()
    for i in range(90):
        rows.append((1000 - i, " ".join(words), "en", "a", 0))
        words = [f"z{rng.randrange(99999)}" if rng.random() < 0.012 else w for w in words]
    assert found(spark, rows) == brute(rows)


def test_large_groups_and_blocks(spark, monkeypatch):
    """Near copies whose pairs lie on both sides of the threshold, enumerated by bitmaps and in blocks."""
    rng = random.Random(12)
    base, rows = sentence(rng, 90).split(), []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(90)] = f"u{rng.randrange(99999)}"
        rows.append((i, " ".join(words[: rng.randrange(80, 91)]), "en", "a", 0))
    wanted = brute(rows)
    assert len({c for _, c in wanted.values()}) > 5
    for held in (256, 10):
        monkeypatch.setattr(J, "BLOCK_SETS", held)
        assert found(spark, rows) == wanted


def test_every_link_is_given(spark, monkeypatch):
    """All pairs of a large group of near copies, not only enough for its component; once each, also in blocks and by matrices."""
    rng = random.Random(5)
    base, rows = sentence(rng, 300).split(), []
    for i in range(130):
        words = list(base)
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(300)] = f"u{rng.randrange(99999)}"
        rows.append((i, " ".join(words), "en", "a", 0))
    rows += [(1000 + i, text, *rest) for i, (_, text, *rest) in enumerate(hard_documents())]
    by_set = {}
    for doc_id, text, *_ in rows:
        key = tuple(shingle_set(split_words(text, lower=True), 5).tolist())
        by_set[key] = min(doc_id, by_set.get(key, doc_id))
    sets, wanted = sorted((i, set(k)) for k, i in by_set.items() if k), {}
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if 100 * len(a & b) >= 80 * len(a | b):
                wanted[i, j] = len(a & b)
    assert len(wanted) > 3000
    for held in (256, 20):
        monkeypatch.setattr(J, "BLOCK_SETS", held)
        join = J.ngram_join(spark.createDataFrame(rows, DOCS))
        got = [(*sorted((r.id_a, r.id_b)), r.shared) for r in join.by_id().collect()]
        assert len(got) == len(wanted) and {(a, b): n for a, b, n in got} == wanted
        counts = {r.doc_id: r.n_links for r in join.by_document().collect()}
        assert all(counts[i] == sum(i in pair for pair in wanted) for i, _ in sets)


def test_clash_nulls_and_empty(spark):
    rows = [(None, "a b c d e f", None, None, 0), (5, "a b c d e f", None, None, 0), (None, None, None, None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.ngram_components(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(None, 2, 5), (5, 2, 5), (None, 0, None)], key=str)
    assert J.ngram_components(documents(spark).where("false")).collect() == []
    kept = J.keep_one_of_each(clashing(documents(spark)))
    wanted = {d for d, (_, c) in brute(hard_documents()).items() if d == c}
    assert {r.doc_id for r in kept.collect()} == wanted and kept.columns == clashing(documents(spark)).columns


def test_bitmap_bounds_the_difference():
    rng = np.random.default_rng(3)
    for n, changed in [(10, 2), (300, 30), (5000, 1), (40, 400)]:
        a = np.unique(mix(rng.integers(0, 1 << 60, n).astype(np.uint64)))
        b = np.unique(np.concatenate([a[changed:], mix(rng.integers(0, 1 << 60, changed).astype(np.uint64))]))
        assert J.distances([J.parity_bitmap(a), J.parity_bitmap(b)], np.array([0]), np.array([1]))[0] <= len(np.setxor1d(a, b))


def test_prefixes_share_enough():
    rng = random.Random(2)
    table = np.array([rng.randrange(50) for _ in range(1 << 12)], np.uint32).repeat(1 << (J.BUCKET_BITS - 12))
    for _ in range(200):
        words = sentence(rng, rng.randrange(5, 200)).split()
        other = [f"y{rng.randrange(99)}" if rng.random() < 0.02 else w for w in words]
        a, b = (shingle_set([w.encode() for w in x], 5) for x in (words, other))
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 80 * (len(a) + len(b) - shared):
            (p, m), (q, k) = (J.prefix(x, table, 5.0, 80) for x in (a, b))
            assert len(np.intersect1d(p, q)) >= min(m, k)


def test_the_prefix_adapts_when_the_buckets_are_full():
    """Every bucket holds thousands of other shingles, so its counts tell nothing; sets that 200 near copies share are still foretold, others aren't."""
    rng = np.random.default_rng(6)
    table = rng.poisson(5000, 1 << J.BUCKET_BITS).astype(np.uint32)
    noise = float(np.median(table)) * 1.5 + 2
    found = {}
    for copies in (1, 200):
        for _ in range(50):
            shingles = np.unique(mix(rng.integers(0, 1 << 60, 300).astype(np.uint64)))
            counted = J.Rarity(table, shingles[: J.LOWEST] if copies > 1 else shingles[:0], np.full(J.LOWEST if copies > 1 else 0, float(copies)))
            assert J.prefix(shingles, table, noise, 80)[1] == 1
            found.setdefault(copies, set()).add(J.prefix(shingles, table, noise, 80, counted.others(shingles[: J.LOWEST]))[1])
    assert found[1] == {1} and min(found[200]) > 20


def test_frequent_lowest_shingles_are_counted(spark):
    rng = random.Random(12)
    base = sentence(rng, 80)
    rows = [(i, f"{base} x{i}", "", "", 0) for i in range(40)] + [(100 + i, sentence(rng, 80), "", "", 0) for i in range(40)]
    counted = documents(spark, rows).select("text").mapInArrow(lambda b: J.count_buckets(b, 5), J.COUNTS)
    heavy, held = J.heavy_shingles(counted)
    shingles = shingle_set([w.encode() for w in f"{base} x7".split()], 5)
    known = J.Rarity(np.zeros(0, np.uint32), heavy, held).others(shingles[: J.LOWEST])
    assert heavy.tolist() == sorted(heavy.tolist()) and len(heavy) <= 2 * J.LOWEST and sum(k == 39 for k in known) >= J.LOWEST - 2
    assert J.heavy_shingles(counted.where("false"))[0].tolist() == []


def test_an_id_with_two_texts(spark):
    """One text of the id has an earlier near copy and goes; the other stays."""
    text = sentence(random.Random(1), 60)
    rows = [(1, text, None, None, 0), (2, text + " x", None, None, 0), (2, "another text that nothing resembles at all", None, None, 0)]
    kept = J.keep_one_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([rows[0][:2], rows[2][:2]])


def test_pairs_must_share_their_prefix_shingles():
    """A pair that shares fewer prefix shingles than the smaller m is not a candidate, whatever its bitmaps say."""
    bits, batch = J.parity_bitmap(np.arange(1, 9, dtype=np.uint64)), lambda m: pa.RecordBatch.from_pydict(
        {"low": [1, 1], "high": [1, 1], "node": [7, 8], "block": [1, 1], "n": [9, 9], "m": [m, m + 1], "bitmap": [bits] * 2, "tokens": pa.array([[1, 2, 3], [2, 3, 4]], pa.list_(pa.int64()))}
    )
    assert [[r["node"] for r in b.to_pylist()] for b in J.match(iter([batch(2)]), 80)] == [[7, 8]]
    assert [b.num_rows for b in J.match(iter([batch(3)]), 80)] == [0]


@pytest.mark.parametrize("text,n", [("", 0), (None, 0), (" \n", 0), ("a", 1), ("a b c d", 1), ("a b c d e", 1), ("a b c d e f", 2), ("a a a a a a", 1)])
def test_set_sizes(text, n):
    assert len(shingle_set(split_words(text), 5)) == n
