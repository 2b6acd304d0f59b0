"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are its words, the shapes of its words (letters, digits and case folded away, marks
kept), pairs of neighbouring words and of neighbouring shapes, and immediate repeats, each hashed into one
table and weighted by its share of the text. A score is the sparse dot product of shares and weights.

Training takes at most ``train_documents`` labelled documents, chosen by a hash of their id: a documented
bound, so that one task can learn them in order. Scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.words import documents_only


@dataclass(frozen=True)
class QualityModel:
    bits: int = 18
    #: Bound on the labelled documents that are learnt.
    train_documents: int = 4_000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.0005
    l2: float = 0.0
    #: Shares are small; this brings them to the order of one.
    scale: float = 20.0
    threshold: float = 0.3
    folds: int = 5


_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def _word_and_shape(word: str) -> tuple[int, int]:
    import xxhash

    shape = _DIGITS.sub("9", _LETTERS.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", word))
    return xxhash.xxh64_intdigest(word.lower()), xxhash.xxh64_intdigest(shape, 1)


class Features:
    """Hashed features of texts; words are remembered while there are few."""

    def __init__(self, bits: int):
        self.shift, self.known = np.uint64(64 - bits), {}

    def _index(self, h: np.ndarray, kind: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            z = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
            return ((z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> self.shift).astype(np.int64)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.int64)
        if len(self.known) > 300_000:
            self.known.clear()
        known = self.known
        pairs = []
        for w in words:
            if (x := known.get(w)) is None:
                x = known[w] = _word_and_shape(w)
            pairs.append(x)
        h = np.array(pairs, np.uint64)
        word, shape = h[:, 0], h[:, 1]
        with np.errstate(over="ignore"):
            two = word[1:] * np.uint64(0xBF58476D1CE4E5B9) + word[:-1]
            shapes = shape[1:] * np.uint64(0xBF58476D1CE4E5B9) + shape[:-1]
        again = np.zeros(int((word[1:] == word[:-1]).sum()), np.uint64)
        return np.concatenate([self._index(word, 1), self._index(shape, 2), self._index(two, 3), self._index(shapes, 4), self._index(again, 5)])


def _logistic(x: float) -> float:
    return 1 / (1 + np.exp(-min(35.0, max(-35.0, x))))


def train(rows: list[tuple[np.ndarray, int]], settings: QualityModel) -> np.ndarray:
    """Weights (the last is the bias) from (features, label) in the given order."""
    size = 2**settings.bits + 1
    z, n = np.zeros(size), np.zeros(size)
    prepared = []
    for features, label in rows:
        index, counts = np.unique(features, return_counts=True)
        prepared.append((np.r_[index, size - 1], np.r_[counts * (settings.scale / max(1, len(features))), 1.0], label))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - settings.l1, 0)
        return -shrunk / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2)

    for _ in range(settings.epochs):
        for index, x, label in prepared:
            w = weights(index)
            g = (_logistic(float(w @ x)) - label) * x
            z[index] += g - (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / settings.alpha * w
            n[index] += g * g
    return weights(slice(None)).astype(np.float32)


def score_text(features: np.ndarray, weights: np.ndarray, settings: QualityModel) -> float:
    total = float(weights[features].sum(dtype=np.float64)) * settings.scale / len(features) if len(features) else 0.0
    return float(_logistic(total + float(weights[-1])))


def fold(key: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are in no fold (-1)."""
    return F.coalesce(F.crc32(key.cast("string")) % folds, F.lit(-1))


def fit(docs: DataFrame, labels: DataFrame, settings: QualityModel | None = None) -> np.ndarray:
    """Weights learnt from labelled documents outside fold 0. Labels for rows without a document are ignored."""
    import pyarrow as pa

    settings = settings or QualityModel()
    usable = labels.select(F.col("`doc_id`").alias("doc_id"), F.col("`quality`").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), settings.folds) != 0))
    chosen = usable.withColumn("turn", F.xxhash64(F.col("doc_id").cast("string"))).orderBy("turn", "doc_id", "quality").limit(settings.train_documents)
    # The chosen ids are within the documented bound.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("turn", "doc_id", "quality", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(settings.bits)
        for batch in batches:
            found = [features(t).astype("<i4").tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], names=["turn", "doc_id", "quality", "features"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        rows.sort(key=lambda r: (r[0], str(r[1]), r[3]))
        weights = train([(np.frombuffer(f, "<i4").astype(np.int64), q) for _, _, q, f in rows], settings)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    extracted = sample.mapInArrow(extract, f"turn long, doc_id {kind}, quality int, features binary")
    learnt = extracted.repartition(1).mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(learnt[0]["weights"], np.float32) if learnt else np.zeros(2**settings.bits + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, settings: QualityModel | None = None, name: str = "quality_score", text: str = "text") -> DataFrame:
    """``docs`` with its score under ``name``, which must be a new name. Null and empty texts have the bias's score."""
    import pyarrow as pa

    settings = settings or QualityModel()
    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")
    shared = docs.sparkSession.sparkContext.broadcast(np.array(weights))  # 2 ** bits values
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(settings.bits)
        for batch in batches:
            scores = [score_text(features(t), shared.value, settings) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{name}` double")


def quality_digest(docs: DataFrame, labels: DataFrame, settings: QualityModel | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; a null doc_id is never held out."""
    settings = settings or QualityModel()
    plain = documents_only(docs, "doc_id", "text")
    scored = score(plain, fit(plain, labels, settings), settings)
    return scored.select("doc_id", (fold(F.col("doc_id"), settings.folds) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= settings.threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, settings: QualityModel | None = None) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns stay, whatever their names.

    Each row is judged by its text alone, so repeated rows stay or go together; null and empty texts have the
    bias's score; an empty table stays empty, and without usable labels every score is a half and all rows stay.
    """
    settings = settings or QualityModel()
    name = "quality_score"
    while name in docs.columns:
        name += "_"
    scored = score(docs, fit(documents_only(docs, "doc_id", "text"), labels, settings), settings, name)
    return scored.where(F.col(name) >= settings.threshold).drop(name)
