"""Best-fit packing planned on the histogram of lengths.

Documents become pieces of at most ``capacity`` tokens. Best-fit decreasing needs only how many pieces
have each length, and all sequences with the same free space are alike, so the plan is made on at
most ``capacity`` counts: no document passes through the driver. The plan says, for each length, which
ranks go to which sequences at which offset; every piece then finds its place by joining on its rank
within its length.

A null or empty text is the separator alone. Repeated rows are packed as often as they occur; a null id is
kept. A very long text is tokenised whole and cut into pieces; only documents longer than ``capacity`` are cut. Only the id and text
columns are read, so other columns may have any name. An empty table gives no pieces.
"""

from __future__ import annotations

import os
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache, partial
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import RecentCache, bounded_batches, hand_back, materialize, salted_rank

PIECES = "doc_id long, piece int, start long, length long, ids binary"
SEQUENCES = "sequence_id long, length long, ids binary, pieces array<struct<offset: long, doc_id: long, piece: int, start: long, length: long>>"
PLAN = "length long, first_rank long, end_rank long, first_sequence long, in_each long, first_offset long"
#: Words whose ids a worker remembers, in each of two generations.
CACHED_WORDS = 300_000


class WordCache:
    """Ids of white-space separated words as bytes (little-endian unsigned 32-bit).

    The tokenizer never merges across white space, so a text's ids are its words' ids in a row.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # words come here once
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.tails: dict[str, bytes] = {}
        self.recent = RecentCache(self.encode, CACHED_WORDS)

    def alone(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone, encoded as one text: each word ends where a token ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):  # a letter that lower-casing takes apart
            return self.alone(words)
        data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, words: list[bytes]) -> Iterator[bytes]:
        """Most words are letters with punctuation behind; the tokenizer splits these two apart and lower-cases both."""
        for i in range(0, len(words), 256):
            found, plain, stems, tails, other = {}, [], [], [], []
            for word in words[i : i + 256]:
                text = word.decode("utf-8", "replace")
                stem = text.rstrip(punctuation)
                if not (stem.isalpha() and stem.lower().isalpha()):
                    other.append(word)
                    continue
                tail = text[len(stem) :]
                if tail not in self.tails:
                    self.tails[tail] = self.alone([tail])[0] if tail else b""
                known = self.recent.peek(stem.lower().encode()) if stem.isascii() else None
                if known is not None:
                    found[word] = known + self.tails[tail]
                else:
                    plain.append(word)
                    stems.append(stem)
                    tails.append(tail)
            if other:
                found.update(zip(other, self.alone([w.decode("utf-8", "replace") for w in other])))
            if stems:
                found.update((w, ids + self.tails[t]) for w, ids, t in zip(plain, self.letters(stems), tails))
            if len(self.tails) > CACHED_WORDS // 10:
                self.tails = {}
            yield from map(found.__getitem__, words[i : i + 256])

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text. Arrow splits the texts, numbers a batch's distinct words and puts their ids in a row; only those are looked up."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        known = self.recent.covering(set(distinct))
        placed = pa.array([known[w] for w in distinct], pa.large_binary()).take(words.indices)
        ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        if not len(placed):
            yield from [b""] * len(texts)
            return
        _, offsets, data = placed.buffers()
        cuts = np.frombuffer(offsets, np.int64)[placed.offset :][ends].tolist()
        whole = memoryview(data or b"")
        for a, b in zip(cuts, cuts[1:]):
            yield bytes(whole[a:b])


@lru_cache(maxsize=2)
def word_cache(path: str) -> WordCache:
    return WordCache(path)


@lru_cache(maxsize=8)
def id_type(path: str, separator: int) -> str:
    """The type of a piece's ids: two bytes where all ids fit, as pieces are moved twice."""
    return "<u2" if max(len(word_cache(path).ends_word) - 1, separator) < 1 << 16 else "<u4"


def cut_pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, separator: int) -> Iterator[pa.RecordBatch]:
    cache, end = word_cache(path), separator.to_bytes(4, "little")
    kept = id_type(path, separator)
    hand_back()
    for batch in batches:
        rows = []
        for doc_id, ids in zip(batch.column(0).to_pylist(), cache.ids(batch.column(1))):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((doc_id, piece, at // 4, len(part) // 4, np.frombuffer(part, "<u4").astype(kept).tobytes()))
        columns = list(zip(*rows)) or [[]] * 5
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids"])
    cache.recent.forget_old()  # words that the last texts had stay
    hand_back()


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of PLAN: ranks [first, end) of a length fill sequences from ``first_sequence``, ``in_each`` in each.

    Lengths are taken from the longest. An item goes to the fullest open sequence that has room, as in
    best-fit over items, but whole runs of equal sequences are filled at once.
    """
    plan, opened = [], 0
    spaces: list[int] = []  # the free spaces that occur, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # free space: runs of sequences (first, how many)

    def put(space: int, first: int, many: int) -> None:
        if space and many:
            if space not in runs:
                insort(spaces, space)
                runs[space] = []
            runs[space].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, many = runs[space].pop()
                if not runs[space]:
                    del runs[space], spaces[at]
            else:
                space = capacity
                first, many = opened, -(-left // (capacity // length))
                opened += many
            in_each = space // length
            used = min(many, -(-left // in_each))
            taken = min(left, used * in_each)
            plan.append((length, rank, rank + taken, first, in_each, capacity - space))
            last = taken - (used - 1) * in_each
            put(space - in_each * length, first, used - 1)
            put(space - last * length, first + used - 1, 1)
            put(space, first + used, many - used)
            rank, left = rank + taken, left - taken
    return plan


def length_salts(counts: dict[int, int], salt_rows: int) -> list[tuple[int, int]]:
    return [(length, max(16, -(-n // salt_rows))) for length, n in counts.items()]


def pack_pieces(pieces: DataFrame, capacity: int = 2048, salt_rows: int = 500_000) -> DataFrame:
    """``pieces`` (at least doc_id, piece, length) with sequence_id and offset. Reads ``pieces`` three times.

    A length is cut into 16 salts, or one for each ``salt_rows`` of its pieces if that is more. What is broadcast has at most 16 rows a length, one more for each
    ``salt_rows`` pieces, and the plan: 32768 rows and 2 for a million pieces, with a capacity of 2048.
    """
    spark = pieces.sparkSession
    counts = dict(pieces.groupBy("length").count().collect())  # at most ``capacity`` rows
    plan = F.broadcast(spark.createDataFrame(best_fit_plan(counts, capacity), PLAN))
    salts = spark.createDataFrame(length_salts(counts, salt_rows), "length long, _salts int")
    ranked = salted_rank(pieces, "length", ["doc_id", "piece"], salts)
    turn = "(rank - first_rank)"
    return ranked.join(plan, (ranked.length == plan.length) & F.expr("rank >= first_rank and rank < end_rank")).select(
        *(ranked[c] for c in pieces.columns),
        F.expr(f"first_sequence + {turn} div in_each").alias("sequence_id"),
        (F.col("first_offset") + F.expr(f"{turn} % in_each") * ranked.length).alias("offset"),
    )


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(cut_pieces, path=tokenizer_path, capacity=capacity, separator=separator), PIECES)


def assemble(batches: Iterator[pa.RecordBatch], path: str, separator: int) -> Iterator[pa.RecordBatch]:
    """A row of SEQUENCES for each sequence and its parts in order of offset. All texts are tokens by now, so the worker lets go of its words."""
    kept = id_type(path, separator)
    word_cache.cache_clear()
    hand_back()
    for batch in batches:
        parts = batch.column("parts")
        each, ends = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
        ids = each.field("ids").to_pylist()
        whole = [np.frombuffer(b"".join(ids[a:b]), kept).astype("<u4").tobytes() for a, b in zip(ends, ends[1:])]
        names = ["offset", "doc_id", "piece", "start", "length"]
        pieces = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([each.field(n) for n in names], names))
        lengths = pa.array([len(w) // 4 for w in whole], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), lengths, pa.array(whole, pa.binary()), pieces], ["sequence_id", "length", "ids", "pieces"])


def packed_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0, **columns) -> DataFrame:
    """sequence_id, length, ids (of all pieces in order of offset, little-endian unsigned 32-bit), pieces (offset, doc_id, piece, start, length)."""
    pieces = materialize(tokenize_pieces(docs, tokenizer_path, capacity, separator, **columns), "pieces", compression="zstd")
    part = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    packed = pack_pieces(pieces, capacity).groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return packed.mapInArrow(partial(assemble, path=tokenizer_path, separator=separator), SEQUENCES)


def piece_digests(sequences: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of the pieces of packed sequences."""
    each = sequences.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    own = F.expr("substring(ids, cast(4 * p.offset + 1 as int), cast(4 * p.length as int))")
    return each.select("p.doc_id", "p.piece", "p.start", "p.length", F.crc32(own).alias("ids_crc32"), "sequence_id", "p.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0, **columns) -> DataFrame:
    """The digests of the packed sequences. Tokenises each document once."""
    return piece_digests(packed_sequences(docs, tokenizer_path, capacity, separator, **columns))
