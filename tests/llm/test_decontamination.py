import hashlib
import random
import re

import pytest
from fixtures import DOCS, clashing, documents, hard_documents, sentence
from pyspark.sql import functions as F

from millrace.llm import decontamination as D

FOLD = {i: i + 32 for i in range(65, 91)}
ITEMS = "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute_force(docs, items, window=10):
    strings = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            strings.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    out = []
    for d, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(s) for s in strings}:
            for i in range(len(w) - m + 1):
                if held := strings.get(tuple(w[i : i + m])):
                    hit.update(range(i, i + m))
                    found |= held
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(8)
    passages = [sentence(rng, n, 40) for n in (30, 12, 10, 9, 5, 2, 1, 40)]
    items = [(i, t) for i, t in enumerate(passages)] + [(20, passages[0]), (21, passages[0].upper() + " more"), (2, "second text of an item " * 3), (None, passages[1]), (30, None), (31, ""), (32, "?! --"), (33, "echo " * 12), (34, "é漢 ß-Ü x")]
    docs = hard_documents()
    for i in range(60):
        p = rng.choice(passages).split()
        a = rng.randrange(len(p))
        cut = p[a : a + rng.randrange(1, 25)]
        docs.append((4000 + i, f"{sentence(rng, rng.randrange(30), 90)},{'-'.join(cut).upper() if i % 3 else ' '.join(cut)}\n{sentence(rng, rng.randrange(30), 90)}", "en", "a", 1))
    docs += [(5000, "É漢 ß ü X", "de", "a", 1), (5001, "é漢 ß-Ü x", "de", "a", 1), (None, passages[0], None, None, None), (5002, passages[0] + " " + passages[0], "en", "b", 2)]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 24, 700])
def test_report(spark, tables, block_bytes):
    docs, items = tables
    df = clashing(spark.createDataFrame(docs, DOCS)).withColumn("row_number", F.lit(1)).withColumn("items", F.lit(2))
    bench = spark.createDataFrame(items, ITEMS).withColumn("string", F.lit("x")).withColumn("item", F.lit("y"))
    found = sorted(map(tuple, D.contamination_report(df, bench, block_bytes=block_bytes).collect()), key=str)
    assert found == brute_force(docs, items)


@pytest.mark.parametrize("window", [1, 2, 4])
def test_other_windows(spark, tables, window):
    docs, items = tables
    found = D.contamination_report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), window=window)
    assert sorted(map(tuple, found.collect()), key=str) == brute_force(docs, items, window)


def test_empty_tables(spark, tables):
    docs, items = tables
    none = spark.createDataFrame([], ITEMS)
    assert sorted(map(tuple, D.contamination_report(documents(spark), none).collect()), key=str) == brute_force(hard_documents(), [])
    assert D.contamination_report(documents(spark).where("false"), spark.createDataFrame(items, ITEMS)).collect() == []


def test_clean_rows_stay(spark, tables):
    docs, items = tables
    df = clashing(spark.createDataFrame(docs, DOCS))
    kept = D.without_spans(df, spark.createDataFrame(items, ITEMS))
    clean = [r[0] for r in brute_force(docs, items) if not r[5]]
    assert kept.columns == df.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, clean))


def test_shifts_skip_words():
    """A text without any block of a string is searched in steps of m - 1 words; each block's shift is its distance from the string's end."""
    m = D.Matcher(10)
    string = tuple(b"abcdefghij"[i : i + 1] for i in range(10))
    m.add(string, "1")
    assert m.shift[b"i j"] == 0 and m.shift[b"a b"] == 8 and m.shift[b"h i"] == 1

    class Counted(list):
        looked = 0

        def __getitem__(self, at):
            self.looked += 1
            return super().__getitem__(at)

    text = Counted([b"z"] * 900)
    assert list(m.find(text)) == [] and text.looked == 2 * 99
    assert list(m.find([b"z"] * 5 + list(string) + list(string))) == [(5, ["1"]), (15, ["1"])]


def test_strings_with_one_end_share_a_bucket():
    m = D.Matcher(3)
    for i in range(50):
        m.add((b"p%d" % i, b"x", b"y"), str(i))
    assert list(m.buckets) == [b"x y"] and list(m.find([b"p7", b"x", b"y", b"x", b"y"])) == [(0, ["7"])]
