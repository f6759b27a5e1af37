"""Quality of documents by ordinal regression on graded ratings.

A cumulative-link model: P(grade <= g) = sigmoid(threshold[g] - score), with one score for all grades, the sum of the
weights of a text's hashed features, and ordered thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquill.llm.names import others, unused
from barquill.llm.words import LOWER, Words, chunks_of, mix, randoms

#: Bits of a hashed feature, and rated documents that a model is fitted on at most.
BITS, SAMPLE = 20, 20_000
EPOCHS, RATE, SHRINK, BATCH = 12, 0.5, 1e-3, 64
KEEP = 0.6

_SALT = randoms(301, 16)
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each text, each once, and their n + 1 bounds.

    Words in lower case, their first five and last three bytes, and how large a share of a text's words repeat the one
    before, end in two marks, are in capitals or are alone as marks, and how many words there are, in steps.
    """
    start, end, n = words.start, words.end, words.n_texts
    whole, head = words.parts(LOWER, [(start, end), (start, np.minimum(start + 5, end))])
    tail = words.parts(LOWER, [(np.maximum(end - 3, start), end)])[0]
    count = np.diff(words.bounds)
    capitals = np.concatenate([[0], np.cumsum(_UPPER[words.data])])
    last = words.data[end - 1] if len(end) else words.data[:0]
    before = words.data[np.maximum(end - 2, start)] if len(end) else last
    again = np.zeros(len(start), bool)
    again[1:] = (whole[1:] == whole[:-1]) & (words.text[1:] == words.text[:-1])
    shares = [again, _PUNCTUATION[last] & _PUNCTUATION[before] & (end - start > 1), 2 * (capitals[end] - capitals[start]) > end - start, _PUNCTUATION[last] & (end - start == 1)]
    steps = [np.ceil(8 * np.bincount(words.text[x], minlength=n) / np.maximum(count, 1)).astype(np.uint64) for x in shares]
    steps.append(np.ceil(np.log2(count + 1)).astype(np.uint64))
    each = np.arange(n)
    owner = np.concatenate([words.text] * 3 + [each] * len(steps))
    value = np.concatenate([whole ^ _SALT[0], head ^ _SALT[1], tail ^ _SALT[2]] + [mix(x + _SALT[3 + i]) for i, x in enumerate(steps)])
    key = np.unique((owner.astype(np.int64) << BITS) | (mix(value) >> np.uint64(64 - BITS)).astype(np.int64))
    return (key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(n + 1))


@dataclass
class Ordinal:
    """Weights by feature, and thresholds between consecutive grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, feature: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """P(grade > g) of each text, for each threshold g."""
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        score = np.bincount(owner, self.weights[feature], len(bounds) - 1)  # each text summed by itself
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fit(feature: np.ndarray, bounds: np.ndarray, grade: np.ndarray, grades: int) -> Ordinal:
    """Fit by AdaGrad steps with soft thresholding, which leaves most features without weight.

    Without ratings all weights are 0 and every text is certain to have the highest grade.
    """
    weights = np.zeros(1 << BITS)
    if not len(grade):
        return Ordinal(weights, np.full(grades - 1, -60.0))
    square = np.full(1 << BITS, 1e-2)
    share = [np.clip(np.mean(grade <= g), 1e-3, 1 - 1e-3) for g in range(grades - 1)]
    low = np.log(share[0] / (1 - share[0]))
    gaps = np.maximum(np.diff([np.log(p / (1 - p)) for p in share]), 0.1)
    rng = np.random.default_rng(5)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + 0.3 * epoch)
        for rows in np.array_split(rng.permutation(len(grade)), max(1, len(grade) // BATCH)):
            sizes = bounds[rows + 1] - bounds[rows]
            at = np.repeat(bounds[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            some, index = np.unique(feature[at], return_inverse=True)
            owner = np.repeat(np.arange(len(rows)), sizes)
            score = np.bincount(owner, weights[some][index], len(rows))
            theta = low + np.concatenate([[0.0], np.cumsum(gaps)])
            y = grade[rows]
            upper = np.where(y < grades - 1, _sigmoid(theta[np.minimum(y, grades - 2)] - score), 1.0)
            lower = np.where(y > 0, _sigmoid(theta[np.maximum(y - 1, 0)] - score), 0.0)
            slope = 1.0 - upper - lower  # of minus the log-likelihood by the score
            step = np.bincount(index, slope[owner], len(some)) / len(rows)
            square[some] += step * step
            pace = rate / np.sqrt(square[some])
            moved = weights[some] - pace * step
            weights[some] = np.sign(moved) * np.maximum(np.abs(moved) - pace * SHRINK, 0.0)
            likely = np.maximum(upper - lower, 1e-9)
            at_upper, at_lower = upper * (1 - upper) / likely, lower * (1 - lower) / likely
            by = np.array([np.sum(np.where(y == g, -at_upper, 0) + np.where(y == g + 1, at_lower, 0)) for g in range(grades - 1)]) / len(rows)
            low -= rate * by.sum()
            gaps = np.maximum(gaps - rate * np.cumsum(by[::-1])[::-1][1:], 0.05)
    return Ordinal(weights, low + np.concatenate([[0.0], np.cumsum(gaps)]))


def train(docs: DataFrame, ratings: DataFrame, grades: int, sample: int = SAMPLE) -> Ordinal:
    """Fit on at most ``sample`` rows of ``ratings`` (doc_id, grade from 0), those with the smallest hashes of doc_id.

    Features are made where the texts are; one task gathers those of the sample, whose size is bounded, and fits. A document
    that was rated several times, or stands in several rows, counts once for each of its grades, by the smallest of its
    lists of features, however many rows it has.
    """
    rated = ratings.where("doc_id is not null and grade is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade"))
    rated = rated.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in chunks_of(batch.column(2)):
                feature, bounds = features(words)
                rows = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(feature))
                part = batch.slice(words.first, words.n_texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), rows], names=["doc_id", "grade", "feature"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("grade", "ascending")])
        column = table.column("feature").combine_chunks()
        model = fit(column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]), table.column("grade").to_numpy(), grades)
        used = np.flatnonzero(model.weights)
        return pa.table({"feature": [used.astype(np.int32)], "weight": [model.weights[used]], "threshold": [model.thresholds]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rated), "doc_id").select("doc_id", "grade", "text")
    once = texts.mapInArrow(extract, "doc_id long, grade int, feature array<int>").groupBy("doc_id", "grade").agg(F.min("feature").alias("feature"))
    learned = once.groupBy(F.lit(1).alias("all")).applyInArrow(lambda table: learn(table.select(["doc_id", "grade", "feature"])), "feature array<int>, weight array<double>, threshold array<double>")
    row = learned.first()
    model = fit(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int32), grades)
    if row:
        model.weights[np.array(row.feature, np.int64)] = row.weight
        model.thresholds = np.array(row.threshold)
    return model


def grade(docs: DataFrame, model: Ordinal, keep: float = KEEP) -> DataFrame:
    """``docs`` with quality_grade (expected), quality_tail (probability of the highest grade) and quality_kept.

    A document is kept if the highest grade has a probability of at least ``keep``. A null text is an empty one and is
    graded by its length alone, like any other; a text of any length is read whole. Rows and other columns stay as they
    are, whatever their names, but for columns of the three names given here, which are replaced; an empty table stays
    empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<quality_grade:double,quality_tail:double>")
    def rate(text: pa.Array) -> pa.Array:
        above = [sent.value.above(*features(words)) for words in chunks_of(text)]
        above = np.concatenate(above) if above else np.zeros((0, 1))
        return pa.StructArray.from_arrays([pa.array(above.sum(axis=1)), pa.array(above[:, -1])], ["quality_grade", "quality_tail"])

    (name,) = unused(docs.columns, "quality_rated")
    made = ("quality_grade", "quality_tail", "quality_kept")
    rated = docs.withColumn(name, rate(F.col("text"))).select(*others(docs.columns, *made), f"{name}.quality_grade", f"{name}.quality_tail")
    return rated.withColumn("quality_kept", F.col("quality_tail") >= keep)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades from (doc_id, quality, toxic): 0 for toxic texts, 1 for poor ones, 2 for good ones; null if either is null."""
    level = F.when(F.col("toxic") == 1, 0).when((F.col("toxic") == 0) & (F.col("quality") == 0), 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 2)
    return labels.select("doc_id", level.alias("grade"))
