"""Toxicity scores from a convolutional text classifier, trained here in numpy.

A word's vector is the sum of hashed embeddings: of the word without outer punctuation and of its first letters (3, 4, 5 and 7), so
that inflected forms of a stem share most of their vector. Filters of widths 1 to 3 run over the word
vectors, each takes its maximum over the whole text, and a logistic layer reads these maxima. Training
starts from hashed log-odds, shrunk for rare words, in the first dimension and follows gradients through the maxima.

Thresholds are calibrated by language on scores of learning rows by models that were trained without them (``FOLDS`` parts in turn); the
model that scores is trained on all learning rows. The language is read from the text itself (hashed word counts by language, learnt on the
same rows); labels, lang, source and doc_id are never inputs of a score. Scores are shifted so that each language's threshold is at 0.7.

Training is one task over a bounded sample of labelled rows: at most ``max_rows`` of them, a third of them at
most toxic, chosen by a hash of doc_id, of texts of at most ``max_chars`` characters. Only the trained arrays (9 MB, whatever the data's size) go
through the driver. Scoring reads every whole text; a very long one piece by piece, with the same result as in one.

A null or empty text has one zero word vector and gets that score; with no labelled rows of both classes every score is 0. Labels that are
null or without a document are ignored; repeated rows are scored alike. Other columns may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, fresh

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 12, 6, (1, 2, 3)
#: First letters of a word that are hashed beside the word itself.
STEMS = (3, 4, 5, 7)
HASHES = 1 + len(STEMS)
CUT = 0.7
#: Parts of the learning rows that are scored in turn for the thresholds; documents of weight that pull a word's log-odds to the average.
FOLDS, SHRINKAGE = 3, 5.0
#: What an error in another language counts for a language's threshold.
FOREIGN = 0.1
CACHED_WORDS = 100_000
#: Words of a text that are scored at a time, and of all texts in one matrix; bytes that are split into words at a time.
PIECE_WORDS, MATRIX_WORDS, SPLIT_BYTES = 50_000, 200_000, 1 << 20
OUTER = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "…”“’‘«»¿¡"
SPACE = re.compile(rb"\s")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_buckets(word: bytes) -> tuple[int, ...]:
    w = word.decode("utf-8", "replace").lower().strip(OUTER)
    return tuple(zlib.crc32(x.encode()) % BUCKETS for x in (f"w{w}", *(f"{n}{w[:n]}" for n in STEMS)))


def pieces(text: str | None) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Runs of at most PIECE_WORDS words, each with the two words after it; the last, maybe empty, has none."""
    data, held, at = (text or "").encode("utf-8", "replace"), [], 0
    while at < len(data):
        space = SPACE.search(data, min(len(data), at + SPLIT_BYTES))
        end = space.start() if space else len(data)
        held += data[at:end].split()
        at = end
        while len(held) >= PIECE_WORDS + 2:
            yield held[:PIECE_WORDS], held[PIECE_WORDS : PIECE_WORDS + 2]
            held = held[PIECE_WORDS:]
    yield held, []


@dataclass
class Model:
    """Arrays of a fixed size (about 9 MB), whatever the data's size."""

    embedding: np.ndarray  # BUCKETS x DIM
    filters: dict[int, np.ndarray]  # width -> (width*DIM) x FILTERS
    bias: dict[int, np.ndarray]
    weights: np.ndarray
    intercept: float
    languages: list[str]
    language_odds: np.ndarray  # BUCKETS x languages
    thresholds: np.ndarray  # logit by language

    def words(self, buckets: np.ndarray) -> np.ndarray:
        """Word vectors, then the log-odds of each language: by whole word only."""
        return np.hstack([self.embedding[buckets].sum(axis=1), self.language_odds[buckets[:, 0]]]).astype(np.float32)

    def pooled(self, x: np.ndarray, starts: np.ndarray, at: bool = False):
        """Maximum of each filter over each text of ``x``; with ``at`` also where.

        A text is its words, one zero row at least, and two rows that complete the last windows but begin none.
        """
        maxima, where, ends = [], [], np.append(starts[1:], len(x))
        for width in WIDTHS:
            y = x[:, :DIM] @ self.filters[width][:DIM]
            for k in range(1, width):
                y[:-k] += x[k:, :DIM] @ self.filters[width][k * DIM : (k + 1) * DIM]
            y[ends - 1] = y[ends - 2] = -np.inf
            top = np.maximum.reduceat(y, starts, axis=0)
            maxima.append(np.tanh(top + self.bias[width]))
            if at:
                where.append(np.array([y[a:b].argmax(axis=0) + a for a, b in zip(starts, ends)]))
        return (np.hstack(maxima), where) if at else np.hstack(maxima)

    def logits(self, maxima: np.ndarray) -> np.ndarray:
        return (maxima @ self.weights + self.intercept).astype(np.float64)

    def scores(self, maxima: np.ndarray, language: np.ndarray) -> np.ndarray:
        shifted = self.logits(maxima) - self.thresholds[language] + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(shifted, -30, 30)))


class Reader:
    """What the model reads of texts, with a bounded cache of word vectors."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.table = np.zeros((1024, DIM + len(self.model.languages)), np.float32)  # row 0: no word
        self.used = 1

    def matrix(self, runs: list[tuple[list[bytes], list[bytes]]]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the runs' words, each followed by two rows, and where each run starts."""
        met = {w for run in runs for part in run for w in part}
        new = list(met.difference(self.row))
        if self.used + len(new) > CACHED_WORDS and self.used > 1:
            self.clear()
            new = list(met)
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            vectors = self.model.words(np.array([word_buckets(w) for w in some]))
            while self.used + len(some) > len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            self.table[self.used : self.used + len(some)] = vectors
            self.row.update(zip(some, range(self.used, self.used + len(some))))
            self.used += len(some)
        lengths = np.array([max(1, len(words)) + 2 for words, _ in runs])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        index = np.zeros(int(lengths.sum()), np.int64)
        for start, end, (words, after) in zip(starts, ends, runs):
            index[start : start + len(words)] = [self.row[w] for w in words]
            index[end - 2 : end - 2 + len(after)] = [self.row[w] for w in after]
        x = self.table[index]
        x[ends - 1, DIM:] = x[ends - 2, DIM:] = 0  # they count for the language in the run that begins with them
        return x, starts

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Filter maxima and index of the language of each text."""
        maxima = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf)
        odds = np.zeros((len(texts), len(self.model.languages)))

        def put(owners, runs):
            x, starts = self.matrix(runs)
            np.maximum.at(maxima, owners, self.model.pooled(x, starts))
            np.add.at(odds, owners, np.add.reduceat(x[:, DIM:].astype(np.float64), starts, axis=0))

        owners, runs, size = [], [], 0
        for i, text in enumerate(texts):
            for run in pieces(text):
                owners.append(i)
                runs.append(run)
                size += len(run[0]) + 3
                if size >= MATRIX_WORDS:
                    put(owners, runs)
                    owners, runs, size = [], [], 0
        if runs:
            put(owners, runs)
        return maxima, odds.argmax(axis=1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.model.scores(*self.features(texts)) if texts else np.zeros(0)


def blank_model(languages: list[str]) -> Model:
    rng = np.random.default_rng(7)
    filters = {w: rng.normal(0, 0.05, (w * DIM, FILTERS)) for w in WIDTHS}
    for w in WIDTHS:
        filters[w][::DIM] += 0.25 / w  # every filter starts as a mean of log-odds
    return Model(
        embedding=rng.normal(0, 0.02, (BUCKETS, DIM)),
        filters=filters,
        bias={w: np.zeros(FILTERS) for w in WIDTHS},
        weights=np.full(FILTERS * len(WIDTHS), 0.2),
        intercept=0.0,
        languages=languages,
        language_odds=np.zeros((BUCKETS, len(languages))),
        thresholds=np.zeros(len(languages)),
    )


def start_from_odds(model: Model, docs: list[np.ndarray], labels: np.ndarray, languages: np.ndarray) -> None:
    """First embedding dimension: log-odds of documents that hold the bucket, shrunk to none for rare ones. Then the language table."""
    held = np.zeros((2, BUCKETS))
    by_language = np.full((BUCKETS, len(model.languages)), 0.5)
    for buckets, label, language in zip(docs, labels, languages):
        held[label, np.unique(buckets)] += 1
        np.add.at(by_language[:, language], buckets[:, 0], 1)
    total = np.bincount(labels, minlength=2)
    base = SHRINKAGE * total / total.sum()
    odds = np.log((held[1] + base[1]) / (total[1] + base[1])) - np.log((held[0] + base[0]) / (total[0] + base[0]))
    model.embedding[:, 0] += odds / HASHES
    share = by_language / by_language.sum(axis=0)
    model.language_odds = np.log(share / share.mean(axis=1, keepdims=True))


def hashed(texts: list[str | None]) -> list[np.ndarray]:
    """The buckets of each word of each text."""
    known: dict[bytes, tuple] = {}
    docs = []
    for text in texts:
        words = [w for run, _ in pieces(text) for w in run]
        known.update((w, word_buckets(w)) for w in set(words).difference(known))
        docs.append(np.array([known[w] for w in words], np.int32).reshape(-1, HASHES))
    return docs


def matrix_of(model: Model, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    blank = np.zeros((3, DIM + len(model.languages)), np.float32)
    parts = [p for d in docs for p in (model.words(d), blank[: 2 + (len(d) == 0)])]
    lengths = np.array([max(1, len(d)) + 2 for d in docs])
    return np.vstack(parts), np.cumsum(lengths) - lengths


def gradients(model: Model, docs: list[np.ndarray], labels: np.ndarray, weight: np.ndarray):
    """Of the weighted mean loss: by weights, intercept, filters, bias, and by the embeddings of the buckets that are met."""
    x, starts = matrix_of(model, docs)
    pooled, where = model.pooled(x, starts, at=True)
    p = 1 / (1 + np.exp(-np.clip(pooled @ model.weights + model.intercept, -30, 30)))
    error = (p - labels) * weight / len(docs)
    back = error[:, None] * model.weights * (1 - pooled**2)
    owner = np.repeat(np.arange(len(docs)), np.diff(np.append(starts, len(x))))
    flat = np.concatenate([np.vstack([d, np.full((2 + (len(d) == 0), HASHES), -1, np.int32)]) for d in docs])
    filters, bias = {}, {}
    moved = np.zeros((len(x), DIM))
    for n, width in enumerate(WIDTHS):
        part = back[:, n * FILTERS : (n + 1) * FILTERS]
        filters[width] = np.zeros_like(model.filters[width])
        bias[width] = part.sum(axis=0)
        for k in range(width):
            at = np.minimum(where[n] + k, len(x) - 1)
            inside = (owner[at] == np.arange(len(docs))[:, None]) * part
            block = slice(k * DIM, (k + 1) * DIM)
            for f in range(FILTERS):
                filters[width][block, f] += x[at[:, f], :DIM].T @ inside[:, f]
                np.add.at(moved, at[:, f], inside[:, f : f + 1] * model.filters[width][block, f])
    hit = np.flatnonzero((np.abs(moved).sum(axis=1) > 0) & (flat[:, 0] >= 0))
    met, inverse = np.unique(flat[hit].ravel(), return_inverse=True)
    embedding = np.zeros((len(met), DIM))
    np.add.at(embedding, inverse, np.repeat(moved[hit], HASHES, axis=0))
    return pooled.T @ error, error.sum(), filters, bias, met, embedding


def train_on(docs: list[np.ndarray], labels: np.ndarray, language: np.ndarray, names: list[str], epochs: int, rate: float, batch: int) -> Model:
    """A model without thresholds. Deterministic."""
    model, rng = blank_model(names), np.random.default_rng(11)
    start_from_odds(model, docs, labels, language)
    grown = {"e": np.full((BUCKETS, DIM), 1e-6, np.float32), "w": np.full(len(model.weights), 1e-6), "b": 1e-6} | {w: np.full((w * DIM, FILTERS), 1e-6) for w in WIDTHS}

    def step(key, value, gradient):
        grown[key] += gradient**2
        return value - rate * gradient / np.sqrt(grown[key])

    weight = np.where(labels == 1, (labels == 0).mean(), (labels == 1).mean()) * 2
    for _ in range(epochs):
        for chunk in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // batch)):
            weights, intercept, filters, bias, met, embedding = gradients(model, [docs[i] for i in chunk], labels[chunk], weight[chunk])
            model.weights = step("w", model.weights, weights + 1e-5 * model.weights)
            model.intercept = float(step("b", model.intercept, intercept))
            for width in WIDTHS:
                model.filters[width] = step(width, model.filters[width], filters[width])
                model.bias[width] = model.bias[width] - 0.1 * rate * bias[width]
            grown["e"][met] += embedding**2
            model.embedding[met] -= rate * embedding / np.sqrt(grown["e"][met])
    model.embedding = model.embedding.astype(np.float32)
    model.language_odds = model.language_odds.astype(np.float32)
    model.filters = {w: f.astype(np.float32) for w, f in model.filters.items()}
    return model


def train(texts: list[str | None], labels: np.ndarray, langs: list[str], epochs: int = 2, rate: float = 0.05, batch: int = 64) -> Model:
    """A model of all rows, with thresholds from scores of rows by models that didn't see them."""
    names = sorted(set(langs)) or [""]
    if np.bincount(labels, minlength=2).min() < FOLDS:
        model = blank_model(names)
        model.intercept, model.weights = -30.0, model.weights * 0
        return model
    docs, language = hashed(texts), np.array([names.index(x) for x in langs])
    fold, rng = np.zeros(len(docs), int), np.random.default_rng(11)
    for label in (0, 1):
        own = rng.permutation(np.flatnonzero(labels == label))
        fold[own] = np.arange(len(own)) % FOLDS
    raw, guessed = np.zeros(len(docs)), np.zeros(len(docs), int)
    settings = names, epochs, rate, batch
    for k in range(FOLDS):
        rows, rest = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        part = train_on([docs[i] for i in rows], labels[rows], language[rows], *settings)
        for chunk in np.array_split(rest, max(1, len(rest) // batch)):
            x, starts = matrix_of(part, [docs[i] for i in chunk])
            raw[chunk] = part.logits(part.pooled(x, starts))
            guessed[chunk] = np.add.reduceat(x[:, DIM:].astype(np.float64), starts, axis=0).argmax(axis=1)
    model = train_on(docs, labels, language, *settings)
    model.thresholds = np.full(len(names), best_threshold(raw, labels))
    for k in range(len(names)):
        own = guessed == k
        if labels[own].sum() >= 20 and (labels[own] == 0).sum() >= 20:
            model.thresholds[k] = best_threshold(raw, labels, np.where(own, 1.0, FOREIGN))
    return model


def best_threshold(raw: np.ndarray, labels: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The logit with the fewest errors (by weight); in the middle of its gap."""
    order = np.argsort(raw)
    raw, labels, weight = raw[order], labels[order], (np.ones(len(raw)) if weight is None else weight)[order]
    errors = np.concatenate([[0], np.cumsum(labels * weight)]) + np.concatenate([np.cumsum(((1 - labels) * weight)[::-1])[::-1], [0]])
    cuts = np.concatenate([[raw[0] - 1], (raw[1:] + raw[:-1]) / 2, [raw[-1] + 1]])
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    return float(np.mean(cuts[best]))


def learning_rows(docs: DataFrame, labels: DataFrame, max_rows: int, max_chars: int = 20_000) -> DataFrame:
    """text, lang, toxic of at most ``max_rows`` labelled rows that are not held out, with texts of at most ``max_chars`` characters."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    known = known.where(F.col("_id").isNotNull() & ~held_out(F.col("_id"))).dropDuplicates(["_id"])
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(max_rows // 3)
    chosen = chosen.unionByName(known.where("toxic = 0").orderBy(*order).limit(max_rows - max_rows // 3))
    rows = docs.select("doc_id", "text", "lang").where(F.coalesce(F.length("text"), F.lit(0)) <= max_chars)
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # of rows that repeat an id one is taken, the same each time
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.coalesce(F.min("lang"), F.lit("")).alias("lang"), F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 5000, max_chars: int = 20_000) -> Model:
    """Trained in one task, as the sample is bounded; its arrays come back."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches) or [pd.DataFrame({"doc_id": [], "text": [], "lang": [], "toxic": []})]).sort_values("doc_id", kind="stable")
        model = train(rows["text"].tolist(), rows["toxic"].to_numpy(dtype=np.int64), rows["lang"].tolist())
        yield pd.DataFrame({"model": [zlib.compress(pickle.dumps(model), 1)]})

    found = learning_rows(docs, labels, max_rows, max_chars).coalesce(1).mapInPandas(learn, "model binary").collect()
    return pickle.loads(zlib.decompress(found[0]["model"])) if found else train([], np.zeros(0, np.int64), [])


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each whole text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(shared.value)
        for texts in batches:
            yield pd.Series(reader.scores([t if isinstance(t, str) else None for t in texts]))

    return docs.withColumn(score_col, score(F.col(text_col)))


def score_documents(docs: DataFrame, labels: DataFrame, max_rows: int = 5000) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels, max_rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = 5000) -> DataFrame:
    """The rows of ``docs`` whose score is below the cut."""
    name = fresh(docs, "score")
    return with_scores(docs, fit(docs, labels, max_rows), score_col=name).where(F.col(name) < CUT).drop(name)
