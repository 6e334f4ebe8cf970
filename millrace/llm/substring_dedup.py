"""Removal of word windows that occur in an earlier document, by FM-indexes over shards of the corpus.

A window is ``window`` consecutive words. Its anchor is the smallest hash among its runs of ``anchor`` words, so equal
windows have equal anchors, and consecutive windows with one anchor are one segment. Segments whose anchor occurs
in one document only can't repeat. The others are dealt to shards by anchor; a shard holds each distinct segment once,
with the smallest id of its documents.

Within a shard a segment of the first document has no earlier one and is only indexed; one of the last document can be
earlier than none and is only streamed; those between are both. The index holds the Burrows-Wheeler transform of the
indexed words in a wavelet matrix of packed bits, two bit vectors that mark where index rows stop sharing their first
``window`` and ``window - 1`` words, and the smallest document of each group of rows that share ``window``. Neither the
words nor their order are kept. Segments are streamed against it from right to left, all in step: a backward search
extends each match by a word, a match of ``window`` words is reported with the smallest document of its interval and then
widened to the rows that share one word less (matching statistics capped at the threshold), and a match that can't be
extended starts anew one word before its right end.

An anchor with very many distinct segments is split by window hash into several shards. The pieces that this makes of its
segments are made distinct before they are indexed, so no shard grows with the number of documents that share a window.
Words are ``[^\\x20\\x09-\\x0D]+``, compared by 64-bit hashes. A null or empty text has no words. Documents
with the same id, repeated rows included, are not earlier than one another; a null id is never earlier and loses nothing.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, fresh, hand_back, materialize, may_be_in, salted_lookup
from millrace.llm.shingles import P1, P2, mix, split_words, window_hashes, word_hashes

#: Words of an index; distinct segments of a shard before it is split.
INDEX_WORDS, SHARD_SEGMENTS = 250_000, 4_000
PIECES_AT_ONCE = 20_000
ANCHORS = "anchor long, segment long, row long, doc_id long, start int, count int"
PIECES = "shard long, piece long, split boolean, anchor long, segment long, place int, count int, doc_id long, words binary"
RUNS = "shard long, piece long, split boolean, first int, count int, earliest long"
KEPT = "row long, doc_id long, n_words long, n_removed long, kept string"


def batch_of(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [name for name, _ in fields])


def run_hashes(whole: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run [start, end) of windows: its first and last window overlap, so they and the count determine it."""
    return mix(whole[start] * P1 + whole[end - 1] * P2 + (end - start).astype(np.uint64)).view(np.int64)


def smallest_places(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest value, the leftmost if equal, among each run of ``width`` values. Takes a few arrays as long as ``values``, whatever the width."""
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)  # two runs of ``size``, which overlap in the last round, cover one of ``size + step``
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        size += step
    return at


def segments_of(words: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Anchor, segment hash, first window and number of windows of each run of windows with one anchor occurrence."""
    runs = mix(window_hashes(words, anchor))
    n = len(words) - window + 1
    at = smallest_places(runs, window - anchor + 1)
    cuts = np.flatnonzero(np.diff(at)) + 1
    start, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [n]])
    count = end - start
    return runs[at[start]].view(np.int64), run_hashes(window_hashes(words, window), start, end), start, count


def find_anchors(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = split_words(text)
            if doc_id is None or len(words) < window:
                continue
            a, s, start, count = segments_of(word_hashes(words), window, anchor)
            parts.append((a, s, np.full(len(a), row), np.full(len(a), doc_id), start, count))
        if parts:
            yield batch_of([np.concatenate(x) for x in zip(*parts)], ANCHORS)


def cut_segments(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The words of each wanted segment, a piece of its own; windows of split anchors are dealt by their hash, and runs of them are pieces."""
    for batch in batches:
        out = []
        for doc_id, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            words = split_words(text)
            for w in wanted:
                start, count = w["start"], w["count"]
                if w["splits"] == 1:
                    out.append((w["anchor"], w["segment"], False, w["anchor"], w["segment"], 0, count, doc_id, b" ".join(words[start : start + count + window - 1])))
                    continue
                whole = window_hashes(word_hashes(words[start : start + count + window - 1]), window)
                kind = whole % np.uint64(w["splits"])
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(kind)) + 1, [count]])
                shard = mix(np.array([w["anchor"]], np.int64).view(np.uint64) + kind[cuts[:-1]] * P2).view(np.int64).tolist()
                piece = run_hashes(whole, cuts[:-1], cuts[1:]).tolist()
                for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                    out.append((shard[k], piece[k], True, w["anchor"], w["segment"], a, b - a, doc_id, b" ".join(words[start + a : start + b + window - 1])))
                if len(out) >= PIECES_AT_ONCE:
                    yield batch_of(list(zip(*out)), PIECES)
                    out = []
        yield batch_of(list(zip(*out)) or [[]] * 9, PIECES)


class BitVector:
    """Packed bits with counts before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits in [0, at)."""
        block = at >> 6
        return self.before[block] + np.bitwise_count(self.words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))


class WaveletMatrix:
    """Symbols as rows of bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for shift in range(bits - 1, -1, -1):
            bit = (symbols >> shift) & 1
            self.levels.append((shift, BitVector(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def place(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix [0, at) of each symbol ends in the last row; minus ``place(symbols, 0)`` it is the rank."""
        for shift, row, zeros in self.levels:
            ones = row.ones(at)
            at = np.where((symbols >> shift) & 1, zeros + ones, at - ones)
        return at


class ShardIndex:
    """FM-index of word sequences (64-bit hashes), each with the id of its document. What it holds a word: about 1.5 bits
    for each bit of a symbol, 3 bits of boundaries, and 8 bytes a group of equal windows.
    """

    def __init__(self, sequences: list[np.ndarray], doc_ids: np.ndarray, window: int):
        self.window = window
        lengths = np.array([len(s) for s in sequences])
        starts = np.cumsum(lengths + 1) - lengths - 1
        self.vocabulary, numbers = np.unique(np.concatenate(sequences), return_inverse=True)
        text = np.zeros(int((lengths + 1).sum()), np.int64)
        inside = np.ones(len(text), bool)
        inside[starts + lengths] = False
        text[inside] = numbers + 1  # 0 ends a sequence
        n, symbols = len(text), len(self.vocabulary) + 1
        # prefix doubling: ranks by the first 1, 2, 4, ... words, beyond the window; later words don't matter
        rank, reach, ranks = text, 1, {1: text}
        while True:
            following = np.zeros(n, np.int64)
            following[:-reach] = rank[reach:] + 1
            key = rank * (n + 2) + following
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], (np.diff(key[order]) != 0).cumsum()])
            reach *= 2
            if reach > window:
                break
            ranks[reach] = rank

        def edges(width: int) -> np.ndarray:
            """Whether a row differs from the one before in its first ``width`` words: in a power of two from the left or up to the right end."""
            differs = np.zeros(n, bool)
            differs[0] = True
            if width:
                known = 1 << (width.bit_length() - 1)
                shifted = np.zeros(n, np.int64)
                shifted[: n - (width - known)] = ranks[known][width - known :] + 1
                for part in (ranks[known][order], shifted[order]):
                    differs[1:] |= np.diff(part) != 0
            return differs

        tight, loose = edges(window), edges(window - 1)
        self.tight, self.loose = BitVector(tight), BitVector(loose)
        self.loose_start = np.append(np.flatnonzero(loose), n).astype(np.int32)
        self.documents, owner = np.unique(np.repeat(doc_ids, lengths + 1), return_inverse=True)
        self.earliest = np.minimum.reduceat(owner[order], np.flatnonzero(tight)).astype(np.int32)
        self.size = n
        self.wavelet = WaveletMatrix(text[order - 1], max(1, int(symbols - 1).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:-1]
        every = np.arange(symbols)
        self.origin = self.wavelet.place(every, np.zeros(symbols, np.int64))

    def step(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[symbols] + self.wavelet.place(symbols, at) - self.origin[symbols]

    def numbered(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words; -1 for words that the index doesn't have."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, -1)

    def earliest_documents(self, streamed: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of each streamed sequence the place in ``documents`` of the earliest that has it, -1 if none has."""
        lengths = np.array([len(s) for s in streamed])
        first = np.cumsum(lengths) - lengths
        words = self.numbered(np.concatenate(streamed))
        found = np.full(len(words), -1, np.int64)
        live = np.flatnonzero(lengths >= self.window)
        at = first[live] + lengths[live]  # the match is words [at, at + length)
        begin, length = first[live], np.zeros(len(live), np.int64)
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.size)
        while len(live):
            at = at - 1
            known = words[at] > 0
            symbols = np.where(known, words[at], 0)
            low, high = self.step(symbols, low), self.step(symbols, high)
            match = known & (low < high)
            length = length + 1
            whole = np.flatnonzero(match & (length == self.window))
            row = low[whole]
            found[at[whole]] = self.earliest[self.tight.ones(row + 1) - 1]
            group = self.loose.ones(row + 1)
            low[whole], high[whole], length[whole] = self.loose_start[group - 1], self.loose_start[group], self.window - 1
            # a word that isn't known ends every window over it, other failures only those up to the match's right end
            lost = np.flatnonzero(~match)
            at[lost] = np.where(known[lost], at[lost] + length[lost] - 1, at[lost])
            low[lost], high[lost], length[lost] = 0, self.size, 0
            going = at - begin + length >= self.window  # words left of the match's right end
            going &= at > begin
            at, begin, length, low, high, live = (x[going] for x in (at, begin, length, low, high, live))
        return [found[a : a + max(0, n - self.window + 1)] for a, n in zip(first.tolist(), lengths.tolist())]


def search_shards(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows with their earliest document, of rows (shard, piece, split, count, doc_id, words) sorted by shard; an index takes whole shards."""
    hand_back()
    held, size, last = [], 0, None

    def results():
        ids = np.array([x[4] for x in held], np.int64)
        edge = np.flatnonzero(np.append(True, np.diff(np.array([x[0] for x in held], np.int64)) != 0))
        sizes = np.diff(np.append(edge, len(held)))
        indexed = np.flatnonzero(ids < np.repeat(np.maximum.reduceat(ids, edge), sizes)).tolist()
        streamed = np.flatnonzero(ids > np.repeat(np.minimum.reduceat(ids, edge), sizes)).tolist()
        earlier: dict[int, np.ndarray] = {}
        if indexed:
            sequences = {k: word_hashes(held[k][5].split()) for k in {*indexed, *streamed}}
            index = ShardIndex([sequences[k] for k in indexed], ids[indexed], window)
            for k, places in zip(streamed, index.earliest_documents([sequences[k] for k in streamed])):
                earlier[k] = np.where(places < 0, ids[k], np.minimum(index.documents[places], ids[k]))
        out = []
        for k, (shard, piece, split, count, doc_id, _) in enumerate(held):
            if k not in earlier:
                out.append((shard, piece, split, 0, count, doc_id))
                continue
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(earlier[k])) + 1, [count]])
            out += [(shard, piece, split, a, b - a, int(earlier[k][a])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return batch_of(list(zip(*out)), RUNS)

    for batch in batches:
        for piece in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= INDEX_WORDS and piece[0] != last:
                yield results()
                held, size = [], 0
            held.append(piece)
            last, size = piece[0], size + piece[3] + window - 1
    if held:
        yield results()


def remove_runs(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row, doc_id, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
            words = split_words(text)
            kept = words
            if runs:
                edges = np.zeros(len(words) + 1, np.int64)
                for r in runs:
                    edges[r["start"]] += 1
                    edges[r["start"] + r["count"] + window - 1] -= 1
                kept = [words[i] for i in np.flatnonzero(edges[:-1].cumsum() == 0).tolist()]
            out.append((row, doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
        yield batch_of(list(zip(*out)) or [[]] * 5, KEPT)


def repeated_runs(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """row, doc_id, start, count of the windows of ``rows`` (row, doc_id, text) that an earlier document has too.

    A segment is known by its anchor and its hash, a row by its id and its hash: 64-bit hashes alone would confuse some of 10^12 segments, and a
    confusion would take words out of a text. Among those with one anchor, or one id, it won't happen.
    """
    found = materialize(rows.mapInArrow(partial(find_anchors, window=window, anchor=anchor), ANCHORS), "anchors")
    repeated = materialize(
        found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"), "repeated-anchors"
    )
    likely = may_be_in(found, "anchor", repeated, "anchor").where("may_be_in").drop("may_be_in")
    places = materialize(likely.join(repeated, "anchor", "left_semi"), "places")
    first = F.min(F.struct("doc_id", "row", "start", "count")).alias("s")
    distinct = materialize(places.groupBy("anchor", "segment").agg(first).select("anchor", "segment", "s.*"), "distinct-segments")
    # a piece of a split anchor may be a single window
    shards = f"if(count(1) < {SHARD_SEGMENTS}, 1, cast(1 + greatest(count(1) div {SHARD_SEGMENTS}, sum(count) * {window} div {INDEX_WORDS}) as int))"
    split_anchors = distinct.groupBy("anchor").agg(F.expr(shards).alias("splits")).where("splits > 1")
    marked = salted_lookup(distinct, split_anchors, "anchor", "segment").withColumn("splits", F.coalesce("splits", F.lit(1)))
    by_row = materialize(marked.groupBy("row", "doc_id").agg(F.collect_list(F.struct("anchor", "segment", "start", "count", "splits")).alias("wanted")), "wanted")
    texts = may_be_in(rows, "row", by_row, "row").where("may_be_in").drop("may_be_in").dropDuplicates(["row", "doc_id"])
    pieces = materialize(texts.join(by_row, ["row", "doc_id"]).select("doc_id", "text", "wanted").mapInArrow(partial(cut_segments, window=window), PIECES), "pieces")
    columns = ["shard", "piece", "split", "count", "doc_id", "words"]
    parts = pieces.where("split").groupBy("shard", "piece", "split").agg(F.first("count").alias("count"), F.min("doc_id").alias("doc_id"), F.first("words").alias("words"))
    indexed = pieces.where("not split").select(columns).unionByName(parts.select(columns))
    found = materialize(indexed.repartition("shard").sortWithinPartitions("shard").mapInArrow(partial(search_shards, window=window), RUNS), "found-runs")
    runs = found.where("not split").select(F.col("shard").alias("anchor"), F.col("piece").alias("segment"), "first", "count", "earliest")
    # a piece may lie in very many segments
    key = F.struct("shard", "piece").alias("key")
    inside = salted_lookup(pieces.where("split").select(key, "anchor", "segment", "place"), found.where("split").select(key, "first", "count", "earliest"), "key", "segment", how="inner")
    runs = runs.unionByName(inside.select("anchor", "segment", (F.col("place") + F.col("first")).alias("first"), "count", "earliest"))
    earlier = places.select("anchor", "segment", "row", "doc_id", "start").join(runs, ["anchor", "segment"]).where("earliest < doc_id")
    return earlier.select("row", "doc_id", (F.col("start") + F.col("first")).alias("start"), "count")


def remove_repeats(docs: DataFrame, window: int = 50, anchor: int = 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a hash of id and text), doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    runs = repeated_runs(rows, window, anchor).distinct().groupBy("row", "doc_id").agg(F.collect_list(F.struct("start", "count")).alias("runs"))
    runs = materialize(runs, "removed-runs")
    marked = may_be_in(rows, "row", runs, "row")
    touched = marked.where("may_be_in").join(runs, ["row", "doc_id"], "left").select("row", "doc_id", "text", "runs")
    whole = marked.where("not may_be_in").select("row", "doc_id", "text", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs"))
    return touched.unionByName(whole).mapInArrow(partial(remove_runs, window=window), KEPT)


def without_repeats(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", **options) -> DataFrame:
    """``docs`` with repeated windows taken out of the text; texts that lose nothing stay as they are."""
    id_col, key, own, new = options.get("id_col", "doc_id"), fresh(docs, "row_key"), fresh(docs, "own_id"), fresh(docs, "new_text")
    changed = remove_repeats(docs, text_col=text_col, **options).where("n_removed > 0").select(F.col("row").alias(key), F.col("doc_id").alias(own), F.col("kept").alias(new)).dropDuplicates([key, own])
    changed = materialize(changed, "changed-texts")
    flag = fresh(docs, "may_be_in")
    keyed = may_be_in(docs.withColumn(key, F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))), key, changed, key, flag)
    touched = keyed.where(flag).withColumn(own, F.col(id_col).cast("long")).join(changed, [key, own], "left").withColumn(text_col, F.coalesce(new, text_col))
    if length_col in docs.columns:
        touched = touched.withColumn(length_col, F.when(F.col(new).isNull(), F.col(length_col)).otherwise(F.length(new)).cast(docs.schema[length_col].dataType))
    return touched.select(docs.columns).unionByName(keyed.where(f"not {flag}").select(docs.columns))
