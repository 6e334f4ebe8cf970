"""Small documents with hard cases, shared by the tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def hard_documents(seed=3, copies=12):
    """Exact and near copies, shared passages, nulls, empty, short and long texts, repeated rows, odd white space."""
    rng = random.Random(seed)
    texts = [None, "", "   ", "one", "one two three four", "ONE two", "one  TWO", "\t\x0b\n", "a" * 5000, "é ß İ 漢字 🙂  x"]
    base = sentence(rng, 300)
    texts += [base] * 3 + [base.upper()]
    for _ in range(copies):
        words = base.split()
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
        texts.append(" ".join(words))
    passage = sentence(rng, 70)
    texts += [f"{sentence(rng, rng.randrange(0, 60))} {passage} {sentence(rng, rng.randrange(0, 60))}" for _ in range(8)]
    texts += [" ".join(["echo"] * 120)] * 2 + [sentence(rng, 6000)] + [sentence(rng, rng.randrange(1, 80)) for _ in range(25)]
    rows = [(i * 3 % 1009, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[4], rows[12]]  # repeated rows


def documents(spark, rows=None):
    return spark.createDataFrame(hard_documents() if rows is None else rows, DOCS)


def clashing(df):
    """``df`` with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["row", "digest", "text_sha256", "score", "kept", "node", "token", "rank", "anchor", "group_size", "_salt", "length", "component_id", "may_be_in"]
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
