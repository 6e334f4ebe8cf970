"""Benchmark decontamination: which words of a document lie inside a passage of a test item.

Wu-Manber multi-pattern search over words. A test string is a window of ``window`` consecutive words of an item, or a shorter item as a whole.
For strings of m words the shift table says, for each block of two words, how far the search may advance after it has met that block at the right end: m - 1 if no string
holds the block, else the distance of its last occurrence in a string from that string's end. A shift of 0 selects the bucket of the strings that end with the block, and
direct comparison with the text's last m words confirms an occurrence. Strings of each length have tables of their own, so short items
don't shorten the steps of the others; single words are their own block.

Test strings are made, and made distinct, by Spark. They are dealt by hash to blocks of about ``block_bytes``, and each block is searched in one pass
over all documents; a block is what a task receives, so no task holds more than that, and the driver passes blocks on one at a time. A passage that many items share is in
several blocks if need be. Up to ``block_bytes`` there is one pass, with nothing shuffled.

Words are lower-cased A-Z and split at ASCII characters that are neither letters nor digits. Null and empty texts, of documents or items, have no words; an item without
words is in no document. Texts are searched whole, a document at a time in Python as bytes. Items that repeat an id are one item; a null item id counts as an empty id. Rows that
repeat a doc_id are judged each on their own. Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, fresh, materialize

WINDOW, BLOCK_BYTES = 10, 16 << 20
HITS = "n_words long, spans array<struct<first: bigint, last: bigint>>, items array<string>"
SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
#: A-Z to a-z, ASCII letters, digits and all bytes of longer characters as they are, everything else to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Matcher:
    """Wu-Manber tables for strings of ``m`` words, each with the ids of its items."""

    def __init__(self, m: int):
        self.m, self.reach = m, min(2, m)
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[tuple[bytes, ...], list[str]]] = {}

    def add(self, string: tuple[bytes, ...], item: str) -> None:
        for end in range(self.reach, self.m + 1):
            block = b" ".join(string[end - self.reach : end])
            self.shift[block] = min(self.shift.get(block, self.m), self.m - end)
        self.buckets.setdefault(block, {}).setdefault(string, []).append(item)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """First word and items of every occurrence, from left to right."""
        m, reach, shift, buckets = self.m, self.reach, self.shift, self.buckets
        free, end, n = m - reach + 1, m, len(words)
        while end <= n:
            block = words[end - 1] if reach == 1 else words[end - 2] + b" " + words[end - 1]
            step = shift.get(block, free)
            if not step:
                items = buckets[block].get(tuple(words[end - m : end]))
                if items is not None:
                    yield end - m, items
                step = 1
            end += step


def matchers(strings: list[tuple[bytes, str]]) -> list[Matcher]:
    by_length: dict[int, Matcher] = {}
    for string, item in strings:
        words = tuple(string.split(b" "))
        by_length.setdefault(len(words), Matcher(len(words))).add(words, item)
    return list(by_length.values())


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (first and last word) in order, with those that touch or overlap as one."""
    merged: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if merged and first <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(merged[-1][1], last))
        else:
            merged.append((first, last))
    return merged


def search_texts(batches: Iterator[pa.RecordBatch], block: list[tuple[bytes, str]], name: str) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, HITS)."""
    tables = matchers(block)
    for batch in batches:
        counts, spans, items = [], [], []
        for text in batch.column(1):
            words = words_of(text.as_py())
            found = [(at, at + t.m - 1, held) for t in tables for at, held in t.find(words)]
            counts.append(len(words))
            spans.append([{"first": a, "last": b} for a, b in covered([(a, b) for a, b, _ in found])])
            items.append(sorted({i for _, _, held in found for i in held}))
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, [name, "n_words", "spans", "items"])


def windows_of(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(item, text) to (string, item): the item's windows, in pieces."""

    def pack(item, strings):
        return pa.RecordBatch.from_arrays([pa.array(strings, pa.binary()), pa.array([item] * len(strings), pa.string())], ["string", "item"])

    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = words_of(text.as_py())
            strings = []
            for at in range(max(1, len(words) - window + 1) if words else 0):
                strings.append(b" ".join(words[at : at + window]))
                if len(strings) == 10_000:
                    yield pack(item, strings)
                    strings = []
            if strings:
                yield pack(item, strings)


def item_strings(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """string and item: the distinct pairs."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return items.mapInArrow(partial(windows_of, window=window), "string binary, item string").distinct()


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, n_words, spans (first and last word, from 0, disjoint and in order) and items (sorted ids): one row a document.

    With several blocks the documents' texts are written once, so that every pass gives a row the same number.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    strings = materialize(item_strings(benchmark, item_col, item_text_col, window), "test-strings")
    size = strings.agg(F.coalesce(F.sum(F.octet_length("string") + F.octet_length("item") + 16), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    if blocks == 1:
        block = [(bytes(r["string"]), r["item"]) for r in strings.collect()]
        return texts.mapInArrow(partial(search_texts, block=block, name="doc_id"), f"doc_id {dict(texts.dtypes)['doc_id']}, {HITS}")
    texts = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
    dealt = strings.withColumn("block", F.pmod(F.xxhash64("string", "item"), F.lit(blocks)))
    found = None
    for b in range(blocks):
        block = [(bytes(r["string"]), r["item"]) for r in dealt.where(F.col("block") == b).collect()]
        hits = texts.select("row", "text").mapInArrow(partial(search_texts, block=block, name="row"), f"row long, {HITS}").where("size(items) > 0")
        hits = materialize(hits, "hits")
        found = hits if found is None else found.unionByName(hits)
    merge = F.udf(lambda spans: covered([(s.first, s.last) for s in spans]), "array<struct<first: bigint, last: bigint>>")
    by_row = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hit = by_row.withColumn("spans", merge("spans"))
    counted = texts.mapInArrow(count_words, f"doc_id {dict(texts.dtypes)['doc_id']}, row long, all_words long")
    joined = counted.join(hit, "row", "left")
    empty = {c: F.coalesce(c, F.array().cast(hit.schema[c].dataType)) for c in ("spans", "items")}
    return joined.withColumns(empty).select("doc_id", F.col("all_words").alias("n_words"), "spans", "items")


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [len(words_of(t.as_py())) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "row", "all_words"])


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contaminated_spans(docs, benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no test string, with their own columns. Each row is judged by itself."""
    row = fresh(docs, "row_number")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = contaminated_spans(numbered, benchmark, row, text_col, **options)
    clean = found.where("size(spans) = 0").select(F.col("doc_id").alias(row))
    return numbered.join(clean, row, "left_semi").select(docs.columns)
