import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from fixtures import clashing, documents, hard_documents
from tokenizers import Tokenizer

from millrace.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_layout(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("build", [documents, lambda s: clashing(documents(s))])
def test_against_the_tokenizer(spark, build):
    found = P.pack_documents(build(spark), PATH, capacity=256).collect()
    tokenizer, wanted = Tokenizer.from_file(PATH), []
    for doc_id, text, *_ in hard_documents():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            wanted.append((doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(wanted)
    assert check_layout(found, 256) <= 1.05 * -(-sum(w[3] for w in wanted) // 256) + 1


def test_plan_places_every_rank():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.randrange(2, 60)
        counts = {n: rng.randrange(1, 40) for n in rng.sample(range(1, capacity + 1), rng.randrange(1, capacity))}
        used, places = defaultdict(list), defaultdict(int)
        for length, first, end, sequence, each, offset in P.best_fit_plan(counts, capacity):
            assert first == places[length]
            places[length] = end
            for rank in range(first, end):
                turn = rank - first
                used[sequence + turn // each].append((offset + turn % each * length, length))
        assert places == counts
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        # best-fit decreasing over items, one at a time
        spaces = []
        for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fits = [s for s in spaces if s >= length]
            if fits:
                spaces.remove(min(fits))
            spaces.append((min(fits) if fits else capacity) - length)
        assert len(used) == len(spaces)


def test_salts_follow_each_length(spark):
    """Ranks are gapless within a length, and only lengths with many pieces get many salts."""
    rows = [(i, 0, 9 if i % 3 else i % 7 + 1) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    packed = P.pack_pieces(pieces, 10, salt_rows=50).collect()
    used = defaultdict(list)
    for r in packed:
        used[r.sequence_id].append((r.offset, r.length))
    assert len(packed) == 3000 and all(sorted(parts)[i][0] == sum(n for _, n in sorted(parts)[:i]) for parts in used.values() for i in range(len(parts)))
    counts = {n: 1000 for n in range(1, 2048)} | {2048: 12_000_000_000}
    salts = dict(P.length_salts(counts, 500_000))
    assert salts[2048] == 24_000 and sum(salts.values()) <= 16 * 2048 + sum(counts.values()) // 500_000


def test_sequences_hold_the_tokens(spark):
    tokenizer = Tokenizer.from_file(PATH)
    wanted = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t, *_ in hard_documents()}
    seen = defaultdict(int)
    for r in P.packed_sequences(documents(spark), PATH, capacity=256).collect():
        ids, at = np.frombuffer(r.ids, "<u4"), 0
        assert len(ids) == r.length <= 256
        for p in r.pieces:
            assert p.offset == at and (ids[at : at + p.length] == wanted[p.doc_id][p.start : p.start + p.length]).all()
            at, seen[p.doc_id] = at + p.length, seen[p.doc_id] + p.length
        assert at == r.length
    rows = [d for d, *_ in hard_documents()]
    assert seen == {d: len(wanted[d]) * rows.count(d) for d in rows}


def test_empty_table(spark):
    assert P.pack_documents(documents(spark).where("false"), PATH).collect() == []


def test_a_worker_lets_go_of_old_words_between_tasks():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["one two"])], ["doc_id", "text"])
    P.word_cache.cache_clear()
    cache = P.word_cache(PATH)
    cache.recent.old = {b"old": b""}
    assert [b.num_rows for b in P.cut_pieces(iter([batch]), PATH, 2048, 0)] == [1]
    assert not cache.recent.old and b"one" in cache.recent.young
