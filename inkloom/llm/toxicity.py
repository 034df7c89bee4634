"""Toxicity by a convolutional text classifier, trained in numpy.

Words are embedded by two hashes each, convolved with filters of several widths,
max-pooled over the whole text and weighed by a logistic output. The first
embedding dimension starts from the log odds of a bucket in the training texts,
the rest at random; all weights are then trained by Adagrad on whole texts.
Thresholds are calibrated on a validation part for each language as function
words in the text show it, and scores are bent so that each threshold is 0.7.

It is fitted on TRAIN_TOXIC and TRAIN_CLEAN labelled documents at most (by hash,
whole texts, TRAIN_BYTES in all), on the driver, and scores every text.

Defined cases: a null text is empty and scores as the classifier's bias; rows
without a label teach nothing; with one class only, all scores are 0; repeated
rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_or_empty
from .encoding import small_batches

BUCKETS = 1 << 18
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
TRAIN_TOXIC, TRAIN_CLEAN = 4000, 8000
TRAIN_BYTES = 64 << 20  # of text that comes to the driver
EPOCHS = 4
THRESHOLD = 0.7
#: Words that a worker's cache holds at most; then it starts anew.
CACHE = 600_000
# Common function words, which tell languages apart for calibration.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was with on are be",
    "fr": "le les et est dans un une que pour qui pas des au",
    "de": "der die und das ist nicht ein eine von mit zu den sich auf",
    "es": "el los y en las por con una para del se como lo",
}
_PLACES = 1 << 20  # places of texts that are convolved at once
_STRIP = ".,;:!?\"'()[]{}<>*-_…«»“”‘’"


class Words:
    """Bucket pairs and function-word language of each distinct word, by number."""

    def __init__(self):
        self.languages = {w: i + 1 for i, words in enumerate(FUNCTION_WORDS.values()) for w in words.split()}
        self._clear()

    def _clear(self) -> None:
        # number 0 stands between texts: its embedding is zero
        self.place: dict[str, int] = defaultdict(itertools.count(1).__next__)
        self.buckets = np.full((1, 2), BUCKETS, np.int32)
        self.language = np.zeros(1, np.int8)

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, begin of each text): words with a gap of max width after each text."""
        if len(self.place) > CACHE:
            self._clear()
        gap = max(WIDTHS)
        words = [t.lower().split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(sizes + gap) - sizes - gap
        out = np.zeros(int((sizes + gap).sum()), np.int64)
        flat = np.fromiter(map(self.place.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(sizes.sum()))
        out[np.arange(len(flat)) + np.repeat(np.arange(len(words)) * gap, sizes)] = flat
        new = [w.strip(_STRIP) or w for w in itertools.islice(self.place, len(self.buckets) - 1, None)]
        if new:
            data = [w.encode("utf-8", "surrogatepass") for w in new]
            pairs = np.array([(zlib.crc32(d), zlib.crc32(d, 0x5BD1E995)) for d in data], np.int64)
            # crc32 is linear: a multiplication makes the second hash independent of the first
            pairs[:, 1] = (pairs[:, 1] * 0x9E3779B1 ^ pairs[:, 0] * 0x85EBCA77) >> 11
            self.buckets = np.concatenate([self.buckets, (pairs % BUCKETS).astype(np.int32)])
            self.language = np.concatenate([self.language, np.array([self.languages.get(w, 0) for w in new], np.int8)])
        return out, begins


_WORDS: Words | None = None


def words_of_worker() -> Words:
    global _WORDS
    if _WORDS is None:
        _WORDS = Words()
    return _WORDS


@dataclass
class Classifier:
    embedding: np.ndarray  # (BUCKETS + 1, DIM); the last row is zero
    filters: list[np.ndarray]  # of each width: (width, DIM, FILTERS)
    offsets: list[np.ndarray]  # of each width: FILTERS
    weight: np.ndarray
    bias: float
    thresholds: np.ndarray  # for each language of FUNCTION_WORDS, and first for none

    @classmethod
    def initial(cls, odds: np.ndarray, seed: int = 3) -> Classifier:
        rng = np.random.default_rng(seed)
        embedding = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
        embedding[:-1, 0] = odds / 2  # a word's embedding is the sum of two buckets'
        embedding[-1] = 0
        filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in filters:
            f[:, 0, : FILTERS // 2] += 1 / len(f)
        return cls(embedding, filters, [np.full(FILTERS, -0.5, np.float32) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS), 0.1, np.float32), -1.0, np.full(len(FUNCTION_WORDS) + 1, 0.5))

    def convolved(self, pairs: np.ndarray) -> list[np.ndarray]:
        x = self.embedding[pairs[:, 0]] + self.embedding[pairs[:, 1]]
        out = []
        for f, b in zip(self.filters, self.offsets):
            y = x @ f[0] + b
            for j in range(1, len(f)):
                y[:-j] += x[j:] @ f[j]
            out.append(y)
        return out

    def pooled(self, pairs: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The largest output of each filter in each text: at its words and the first place of the gap after them.

        Places further into the gap would see the next text's words. Long texts
        are taken in parts, so that memory stays bounded.
        """
        ends = np.append(begins[1:], len(pairs)) - max(WIDTHS) + 1
        if len(pairs) <= _PLACES:
            places = np.stack([begins, ends], axis=1).ravel()
            return np.concatenate([np.maximum.reduceat(y, places, axis=0)[::2] for y in self.convolved(pairs)], axis=1)
        out = np.full((len(begins), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        for i, (begin, end) in enumerate(zip(begins.tolist(), ends.tolist())):
            for at in range(begin, end, _PLACES):
                n = min(_PLACES, end - at)
                part = self.convolved(pairs[at : at + n + max(WIDTHS) - 1])
                out[i] = np.maximum(out[i], np.concatenate([y[:n].max(axis=0) for y in part]))
        return out

    def probability(self, pairs: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.maximum(self.pooled(pairs, begins), 0) @ self.weight + self.bias)))

    def bend(self, p: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Scores in which each language's threshold is THRESHOLD."""
        t = self.thresholds[language]
        return np.where(p < t, THRESHOLD * p / t, THRESHOLD + (1 - THRESHOLD) * (p - t) / (1 - t))

    def score(self, texts: list[str]) -> np.ndarray:
        words = words_of_worker()
        numbers, begins = words.numbers(texts)
        p = self.probability(words.buckets[numbers], begins).astype(np.float64)
        return np.clip(self.bend(p, language_of(words, numbers, begins)), 0, 1)


def language_of(words: Words, numbers: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """1 + the language with most function words in each text, or 0 if there are none."""
    language = words.language[numbers]
    counts = np.stack([np.add.reduceat((language == i + 1).astype(np.int32), begins) for i in range(len(FUNCTION_WORDS))], axis=1)
    return np.where(counts.max(axis=1) > 0, counts.argmax(axis=1) + 1, 0)


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Classifier | None:
    """The classifier of labelled texts; None unless there are both classes."""
    if labels.min(initial=1) == labels.max(initial=0):
        return None
    words = Words()
    coded = []
    for at in range(0, len(texts), 200):
        numbers, begins = words.numbers(texts[at : at + 200])
        language = language_of(words, numbers, begins)
        pairs = words.buckets[numbers]
        for a, b, lang in zip(begins.tolist(), [*begins[1:].tolist(), len(numbers)], language.tolist()):
            coded.append((pairs[a:b], lang))
    rng = np.random.default_rng(seed)
    validation = rng.random(len(coded)) < 0.2
    seen = np.zeros((2, BUCKETS + 1))
    for (pairs, _), y in zip(coded, labels):
        seen[y, np.unique(pairs)] += 1
    n = np.bincount(labels, minlength=2)
    odds = np.log((seen[1] + 1) / (n[1] + 2)) - np.log((seen[0] + 1) / (n[0] + 2)) - np.log((n[0] + 2) / (n[1] + 2))
    odds = np.where(seen[1] >= 2, np.clip(odds, 0, 4), 0)[:-1].astype(np.float32)
    model = Classifier.initial(odds)
    params = [*model.filters, *model.offsets, model.weight]
    squares = [np.full_like(p, 0.1) for p in params]
    embedding_squares = np.full(BUCKETS + 1, 0.1, np.float32)
    bias_square, rate = 0.1, 0.05
    classes = [np.flatnonzero((labels == c) & ~validation) for c in (0, 1)]
    if not all(map(len, classes)):
        validation[:] = False
        classes = [np.flatnonzero(labels == c) for c in (0, 1)]
    balance = [0.5 * sum(map(len, classes)) / len(c) for c in classes]
    for _ in range(EPOCHS):
        for i in rng.permutation(np.concatenate(classes)):
            pairs, y = coded[i][0], int(labels[i])
            outputs = model.convolved(pairs)
            at = [o.argmax(axis=0) for o in outputs]
            top = np.concatenate([o[a, np.arange(FILTERS)] for o, a in zip(outputs, at)])
            active = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-float(active @ model.weight + model.bias)))
            slope = (p - y) * balance[y]
            if abs(slope) < 0.02:
                continue
            back = slope * model.weight * (top > 0)
            gradients = [np.zeros_like(f) for f in model.filters], [back[j * FILTERS : (j + 1) * FILTERS] for j in range(len(WIDTHS))]
            touched: dict[int, np.ndarray] = {}
            for j, f in enumerate(model.filters):
                for k in np.flatnonzero(gradients[1][j]):
                    for step in range(len(f)):
                        place = at[j][k] + step
                        if place < len(pairs):
                            one, two = pairs[place]
                            gradients[0][j][step, :, k] += gradients[1][j][k] * (model.embedding[one] + model.embedding[two])
                            for bucket in (int(one), int(two)):
                                if bucket < BUCKETS:
                                    touched[bucket] = touched.get(bucket, 0) + gradients[1][j][k] * f[step, :, k]
            for p_, s_, g in zip(params, squares, [*gradients[0], *gradients[1], slope * active]):
                s_ += g * g
                p_ -= rate * g / np.sqrt(s_)
            bias_square += slope * slope
            model.bias -= rate * slope / bias_square**0.5
            for bucket, g in touched.items():
                embedding_squares[bucket] += float(g @ g)
                model.embedding[bucket] -= rate * g / embedding_squares[bucket] ** 0.5
    checked = np.flatnonzero(validation) if validation.any() else np.arange(len(coded))
    p = np.array([model.probability(coded[i][0], np.zeros(1, np.int64))[0] for i in checked])
    language = np.array([coded[i][1] for i in checked])
    overall = best_threshold(p, labels[checked])
    for lang in range(len(model.thresholds)):
        mine = language == lang
        enough = np.bincount(labels[checked][mine], minlength=2).min() >= 20
        model.thresholds[lang] = best_threshold(p[mine], labels[checked][mine]) if enough else overall
    return model


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap with the best F1."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + max(1, y.sum()))
    values = p[order]
    gap = values - np.append(values[1:], 0)
    f1 = np.where(gap > 0, f1, 0)
    good = np.flatnonzero(f1 >= f1.max() - 1e-9)
    i = good[gap[good].argmax()]
    return float(np.clip(values[i] - gap[i] / 2, 0.02, 0.98))


def held_out() -> Column:
    """Whether a document is kept from learning: the checksum of its id, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> Classifier | None:
    known = labels.where("toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # the first documents of each class by hash: ids alone are sorted, and then these texts are read
    ids = known.select("doc_id", "toxic", F.xxhash64("doc_id").alias("key"))
    chosen = ids.where("toxic = 1").orderBy("key", "doc_id").limit(toxic).unionAll(ids.where("toxic = 0").orderBy("key", "doc_id").limit(clean))
    sizes = docs.select("doc_id", F.octet_length(text_or_empty()).alias("size")).join(F.broadcast(chosen), "doc_id").groupBy("key", "doc_id", "toxic").agg(F.max("size").alias("size"))
    # a row for each chosen id: toxic + clean at most
    fits = F.sum("size").over(Window.partitionBy("toxic").orderBy("key", "doc_id")) <= F.lit(TRAIN_BYTES // 2)
    few = sizes.withColumn("fits", fits).where("fits").select("doc_id", "toxic", "key")
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(few), "doc_id")
    # one text for each chosen id, even where ids repeat
    table = rows.groupBy("key", "doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).toArrow().sort_by([("key", "ascending"), ("doc_id", "ascending")])
    return train(table.column("text").to_pylist(), table.column("toxic").to_numpy().astype(np.int64))


def scored(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """doc_id, score of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for batch in batches:
            for part, texts in small_batches(batch):
                values = shared.value.score(texts) if shared.value else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values)], ["doc_id", "score"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(predict, "doc_id long, score double")


def op8_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
