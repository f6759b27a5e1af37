"""Target-distribution importance resampling: documents drawn by how much more their n-grams belong to a target corpus.

Runs of words are counted in hashed buckets, for all documents and for the target; a bucket's gain is the logarithm of the
two shares' quotient, and a document's weight is the mean gain of its features. Adding Gumbel noise to the weights and
taking the highest draws without replacement, in proportion to the weights' exponentials.

Features are paths in a trie whose edges are words. A node keeps the CRC state of its path, so a longer feature goes on
from the state of the shorter one and is hashed once for each trie, however often it occurs. Tries are local to a task:
counts leave them as totals of buckets, and for scoring each node has its bucket's gain attached.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquill.functions.tables import materialize
from barquill.llm.names import others, unused
from barquill.llm.words import bytes_of

#: Nodes that a trie may have before its counts are poured out and it is begun anew, and bytes of text walked at once.
NODES, SLICE = 1 << 20, 1 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


class _Depth(dict):
    """Edges to the nodes of one depth: from a word, or below the first depth from (node above, word).

    An edge that is missing is made when it is asked for, with its CRC state and, if there are ``gains``, its gain.
    """

    def __init__(self, above: _Depth | None, gains: list[int] | None):
        self.above, self.gains = above, gains
        self.states, self.attached = array("I"), array("q")

    def __missing__(self, edge) -> int:
        if self.above is None:
            state = zlib.crc32(edge)
        else:
            parent, word = edge
            state = zlib.crc32(word, zlib.crc32(b" ", self.above.states[parent]))
        self[edge] = node = len(self.states)
        self.states.append(state)
        if self.gains is not None:
            self.attached.append(self.gains[state % len(self.gains)])
        return node


class Trie:
    """Paths of at most ``order`` words."""

    def __init__(self, order: int, gains: list[int] | None = None):
        self.depths: list[_Depth] = []
        for _ in range(order):
            self.depths.append(_Depth(self.depths[-1] if self.depths else None, gains))

    def __len__(self) -> int:
        return sum(len(d.states) for d in self.depths)

    def walk(self, words: list[bytes], text: np.ndarray, old: int) -> Iterator[tuple[_Depth, np.ndarray, np.ndarray]]:
        """For each depth the nodes of all features that end after the first ``old`` words, and the texts they are in."""
        nodes = np.fromiter(map(self.depths[0].__getitem__, words), np.int64, len(words))
        start = np.arange(len(words))
        for k, depth in enumerate(self.depths):
            if k:
                inside = start + k < len(words)
                inside[inside] = text[start[inside]] == text[start[inside] + k]
                start, nodes = start[inside], nodes[inside]
                edges = zip(nodes.tolist(), [words[i] for i in (start + k).tolist()], strict=True)
                nodes = np.fromiter(map(depth.__getitem__, edges), np.int64, len(start))
            new = start + k >= old
            yield depth, nodes[new], text[start[new]]


def slices(column: pa.Array, order: int, size: int = SLICE) -> Iterator[tuple[list[bytes], np.ndarray, int]]:
    """Words of about ``size`` bytes of texts at a time, the text of each word, and how many words a slice shares with the one before.

    A text that is longer goes on in the next slice, which begins with its last words again, for the features across.
    """
    data, at = bytes_of(column)
    words: list[bytes] = []
    texts: list[int] = []
    counts: list[int] = []
    old = held = 0

    def take() -> tuple[list[bytes], np.ndarray, int]:
        return words, np.repeat(np.array(texts, np.int64), counts), old

    for i in range(len(at) - 1):
        text = data[at[i] : at[i + 1]].tobytes().lower()  # of bytes: A-Z only
        lo = 0
        while lo < len(text):
            gap = _GAP.search(text, lo + size) if len(text) - lo > size else None
            hi = gap.start() if gap else len(text)
            found = _WORD.findall(text, lo, hi)
            words += found
            texts.append(i)
            counts.append(len(found))
            held += hi - lo
            lo = hi
            if held >= size:
                yield take()
                again = words[max(0, len(words) - order + 1) :] if lo < len(text) else []
                again = again[max(0, len(again) - sum(c for t, c in zip(texts, counts, strict=True) if t == i)) :]
                words, texts, counts, old, held = list(again), [i], [len(again)], len(again), 0
    if words:
        yield take()


def bucket_totals(texts: DataFrame, order: int, buckets: int) -> np.ndarray:
    """How many features all rows of ``texts`` (text) have in each bucket: at most ``buckets`` rows leave a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        trie, counts = Trie(order), [np.zeros(0, np.int64)] * order

        def pour() -> None:
            for depth, n in zip(trie.depths, counts, strict=True):
                np.add.at(totals, np.array(depth.states, np.int64) % buckets, n)

        for batch in batches:
            for words, text, old in slices(batch.column(0), order):
                for k, (depth, nodes, _) in enumerate(trie.walk(words, text, old)):
                    now = np.bincount(nodes, minlength=len(depth.states))
                    now[: len(counts[k])] += counts[k]
                    counts[k] = now
                if len(trie) > NODES:
                    pour()
                    trie, counts = Trie(order), [np.zeros(0, np.int64)] * order
        pour()
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains_of(docs: DataFrame, target: DataFrame, order: int, buckets: int) -> list[int]:
    """For each bucket 1000 times the logarithm of its share in ``target`` over its share in ``docs``, smoothed, rounded down."""
    have, want = bucket_totals(docs, order, buckets), bucket_totals(target, order, buckets)
    all_have, all_want = int(have.sum()), int(want.sum())
    pairs = zip(have.tolist(), want.tolist(), strict=True)
    return [math.floor(1000 * math.log((t + 1) * (all_have + buckets) / ((s + 1) * (all_want + buckets)))) for s, t in pairs]


MADE = ("resample_words", "resample_features", "resample_weight", "resample_score")


def with_scores(docs: DataFrame, gains: list[int], order: int, seed: int = 2024) -> DataFrame:
    """``docs`` with the columns of ``MADE``: words, features, mean gain and, with the noise of the document's id, score.

    Rows are scored where they are. A null text has no words, and without features the mean is 0. A null doc_id draws
    its noise as an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    @F.arrow_udf("struct<words:long,features:long,gain:long>")
    def score(column: pa.Array) -> pa.Array:
        found = np.zeros((3, len(column)), np.int64)
        trie = Trie(order, sent.value)
        for words, text, old in slices(column, order):
            found[0] += np.bincount(text[old:], minlength=len(column))
            for depth, nodes, owner in trie.walk(words, text, old):
                found[1] += np.bincount(owner, minlength=len(column))
                found[2] += np.bincount(owner, np.array(depth.attached, np.int64)[nodes], len(column)).astype(np.int64)
            if len(trie) > NODES:
                trie = Trie(order, sent.value)
        return pa.StructArray.from_arrays([pa.array(x) for x in found], ["words", "features", "gain"])

    (name,) = unused([*docs.columns, *MADE], "resample_found")
    done = docs.withColumn(name, score(F.col("text")))
    mean = F.when(F.col(f"{name}.features") > 0, F.floor(F.col(f"{name}.gain") / F.col(f"{name}.features"))).otherwise(0)
    noise = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(noise, 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    made = (F.col(f"{name}.words"), F.col(f"{name}.features"), mean.cast("long"), (mean + gumbel).cast("long"))
    return done.select(*others(docs.columns, *MADE), *(x.alias(c) for x, c in zip(made, MADE, strict=True)))


def _cut(scores: DataFrame, percent: int, min_words: int) -> tuple[int, int | None, DataFrame]:
    """How many rows are drawn, the lowest score drawn (None if none is), and how many rows have a higher score than each.

    Scores are whole thousandths of a logarithm, so there are few of them, however many rows: they are counted by value.
    """
    counts = scores.where(F.col("resample_words") >= min_words).groupBy("resample_score").agg(F.count("*").alias("n"))
    found = sorted(((r.resample_score, r.n) for r in counts.collect()), reverse=True)
    quota, above, steps = percent * sum(n for _, n in found) // 100, 0, []
    for score, n in found:
        if above >= quota:
            break
        steps.append((score, above))
        above += n
    return quota, steps[-1][0] if steps else None, scores.sparkSession.createDataFrame(steps, "resample_score long, above long")


def ranked(scores: DataFrame, percent: int, min_words: int) -> DataFrame:
    """Rows of ``with_scores`` (doc_id and the columns of ``MADE``) with resample_rank: from 1 for those drawn, else null.

    Of the rows with at least ``min_words`` words, ``percent`` in a hundred (rounded down) with the highest scores are
    drawn, ties to the smaller doc_id, a null one last. Only rows of a score that is drawn are shuffled, by score.
    """
    scores = materialize(scores.select("doc_id", *MADE), "scores")
    quota, cut, steps = _cut(scores, percent, min_words)
    null = F.lit(None).cast("long")
    if cut is None:
        return scores.withColumn("resample_rank", null)
    high = (F.col("resample_words") >= min_words) & (F.col("resample_score") >= cut)
    order = Window.partitionBy("resample_score", "above").orderBy(F.asc_nulls_last("doc_id"))
    drawn = scores.where(high).join(steps, "resample_score").withColumn("rank", F.col("above") + F.row_number().over(order))
    drawn = drawn.select("doc_id", *MADE, F.when(F.col("rank") <= quota, F.col("rank")).alias("resample_rank"))
    return drawn.union(scores.where(~high).withColumn("resample_rank", null))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, order: int = 2, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """The rows of ``docs`` that are drawn, whole, with the columns of ``MADE``.

    ``docs`` has doc_id and text, ``target`` has text; further columns of ``docs`` stay, whatever they are called, but for
    those of ``MADE``, which are replaced. Features are runs of 1 to ``order`` words, repeats counted. Texts are read
    twice, once to count and once to score, and shuffled only where they have exactly the lowest score that is drawn.
    Rows of one doc_id have the same noise; equal rows stand together in the order. Empty tables give none.
    """
    scored = with_scores(docs, gains_of(docs, target, order, buckets), order, seed)
    scores = materialize(scored.select("resample_words", "resample_score"), "scores")
    quota, cut, steps = _cut(scores, percent, min_words)
    if cut is None:
        return scored.where("false")
    left = quota - steps.agg(F.max("above")).first()[0]
    (place,) = unused(scored.columns, "resample_place")
    enough = F.col("resample_words") >= min_words
    order_ = Window.partitionBy("resample_score").orderBy(F.asc_nulls_last("doc_id"))
    ties = scored.where(enough & (F.col("resample_score") == cut)).withColumn(place, F.row_number().over(order_)).where(F.col(place) <= left).drop(place)
    return scored.where(enough & (F.col("resample_score") > cut)).union(ties)
