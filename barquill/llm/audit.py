"""How filters of documents interact: what each removes alone, after others, and on average over all their orders.

Texts are scanned as Arrow buffers: classes of bytes, sums up to each byte, and words as 64-bit hashes in order. Every
document becomes a mask of the filters that it fails, and all figures follow from counts of masks.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquill.llm.names import others, unused
from barquill.llm.words import Words, bytes_of, words_of

FILTERS = "ABCDE"

_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True


@dataclass(frozen=True)
class Rules:
    """A document fails A with fewer words than ``words``, B with fewer distinct words in a hundred than ``distinct``, C
    with more capitals (A-Z) in a hundred characters than ``capitals``, D with any of ``symbols``, E as a later copy."""

    words: int = 100
    distinct: int = 80
    capitals: int = 10
    symbols: str = "#$%&*|"


def _same_words(words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words ``a`` have the bytes of words ``b``, eight bytes at a time."""
    size = words.end[a] - words.start[a]
    same = size == words.end[b] - words.start[b]
    data = np.concatenate([words.data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(words.data) + 1, "<u8", data, strides=(1,))
    left, at = np.flatnonzero(same), 0
    while len(left):
        x = eight[words.start[a[left]] + at] ^ eight[words.start[b[left]] + at]
        rest = np.minimum(size[left] - at, 8).astype(np.uint64)
        x &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - rest))
        same[left[x != 0]] = False
        at += 8
        left = left[(x == 0) & (size[left] > at)]
    return same


def distinct_words(words: Words) -> np.ndarray:
    """How many different words each text has: its hashes in order, and words whose hashes are equal compared by their bytes.

    Should two words of a text share a hash, that text's words are compared as they are.
    """
    hashed = words.hashes()
    bits = max(1, int(words.n_texts).bit_length())
    order = np.argsort((words.text.astype(np.uint64) << np.uint64(64 - bits)) | (hashed >> np.uint64(bits)))
    text, value = words.text[order], hashed[order] >> np.uint64(bits)
    equal = np.flatnonzero((text[1:] == text[:-1]) & (value[1:] == value[:-1]))
    same = _same_words(words, order[equal], order[equal + 1])
    found = np.diff(words.bounds) - np.bincount(text[equal[same]], minlength=words.n_texts)
    for i in np.unique(text[equal[~same]]).tolist():
        lo, hi = words.bounds[i], words.bounds[i + 1]
        found[i] = len({words.data[a:b].tobytes() for a, b in zip(words.start[lo:hi], words.end[lo:hi], strict=True)})
    return found


SCANNED = ("words", "distinct", "capitals", "symbols", "code_points")


def scan(column: pa.Array, symbols: str, size: int = 1 << 20) -> np.ndarray:
    """The five counts of ``SCANNED`` for each text of a column, a few texts at a time."""
    data, at = bytes_of(column)
    marked = np.zeros(256, bool)
    marked[list(symbols.encode())] = True
    n, lo = len(at) - 1, 0
    out = np.zeros((len(SCANNED), n), np.int64)
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1))
        part, bounds = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        words = words_of(data, at[lo : hi + 1], lo)
        out[0, lo:hi], out[1, lo:hi] = np.diff(words.bounds), distinct_words(words)
        sums = np.zeros(len(part) + 1, np.int64)
        for row, hit in ((2, _CAPITAL[part]), (3, marked[part]), (4, (part & 0xC0) != 0x80)):
            np.cumsum(hit, out=sums[1:])
            out[row, lo:hi] = np.diff(sums[bounds])
        lo = hi
    return out


def with_failures(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``docs`` with audit_counts (a struct of ``SCANNED``) and audit_failed: bits 1, 2, 4, 8 for filters A to D.

    Filters are judged row by row, without a shuffle; a null text is an empty one. Columns of these two names are replaced.
    """

    @F.arrow_udf("struct<" + ",".join(f"{c}:long" for c in SCANNED) + ">")
    def count(text: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x) for x in scan(text, rules.symbols)], list(SCANNED))

    (name,) = unused([*docs.columns, "audit_failed"], "audit_counts_")
    words, distinct, capitals, symbols, code_points = (F.col(f"{name}.{c}") for c in SCANNED)
    fails = (words < rules.words, 100 * distinct < rules.distinct * words, 100 * capitals > rules.capitals * code_points, symbols > 0)
    mask = sum((F.when(x, F.lit(1 << i)).otherwise(0) for i, x in enumerate(fails)), F.lit(0))
    done = docs.withColumn(name, count(F.col("text")))
    return done.select(*others(docs.columns, "audit_counts", "audit_failed"), F.col(name).alias("audit_counts"), mask.cast("int").alias("audit_failed"))


def mask_counts(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(part, mask, n, good, toxic): documents by language and mask of all five filters, and those labelled good and toxic.

    Texts leave the scan as digests. A row is a later copy if a row with a smaller doc_id has its text anywhere in the
    table; rows without doc_id are no copies and have none. Equal rows are counted before any shuffle, then by text, so a
    text that very many documents share is a row for each of its languages and labels when it meets its first copy.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = with_failures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("lang"), F.lit("")).alias("part")), rules)
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), F.col("audit_failed").alias("mask"))
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    # rows without doc_id meet no label; they are dealt by their text
    rows = rows.withColumn("key", F.coalesce("doc_id", F.xxhash64("digest"))).withColumn("named", F.col("doc_id").isNotNull())
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key"))
    known = known.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"))
    rows = rows.join(known.withColumn("named", F.lit(True)), ["key", "named"], "left").fillna(False, ["is_good", "is_toxic"])
    cells = rows.groupBy("digest", "mask", "part", "is_good", "is_toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("low_n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed")
    )
    first = F.col("low") == F.min("low").over(Window.partitionBy("digest"))
    cells = cells.withColumn("single", F.col("unnamed") + F.when(first, F.col("low_n")).otherwise(0))
    both = F.array(F.struct("mask", F.col("single").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - F.col("single")).alias("n")))
    split = cells.select("part", "is_good", "is_toxic", F.explode(both).alias("x")).select("part", "is_good", "is_toxic", "x.mask", "x.n").where("n > 0")

    def counted(c: str) -> Column:
        return F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c[3:])

    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), counted("is_good"), counted("is_toxic"))


def interactions(masks: DataFrame) -> DataFrame:
    """For each part, order of filters and step what the step's filter does: from counts of masks (``mask_counts``).

    kept and removed by this step, redundant (failing it, but gone before), unique_fails (failing nothing else), good_lost
    and toxic_lost among removed, and shapley: what the filter removes, summed over all orders. At most 32 masks a part.
    """
    orders = ",".join("".join(p) for p in permutations(FILTERS))
    every = masks.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = [F.instr("filter_order", letter) for letter in FILTERS]
    before = sum((F.when(p < F.col("step"), F.lit(1 << i)).otherwise(0) for i, p in enumerate(place)), F.lit(0))
    here = sum((F.when(p == F.col("step"), F.lit(1 << i)).otherwise(0) for i, p in enumerate(place)), F.lit(0))
    every = every.withColumn("here", here).withColumn("gone", F.col("mask").bitwiseAND(before) != 0).withColumn("fails", F.col("mask").bitwiseAND(F.col("here")) != 0)

    def total(which: Column, what: str | Column = "n") -> Column:
        return F.sum(F.when(which, F.col(what) if isinstance(what, str) else what).otherwise(0)).cast("long")

    gone, fails = F.col("gone"), F.col("fails")
    share = F.col("n") * F.expr(f"{factorial(len(FILTERS))} div bit_count(mask)")
    return every.groupBy("part", "filter_order", "step").agg(
        total(~gone & ~fails).alias("kept"), total(~gone & fails).alias("removed"), total(gone & fails).alias("redundant"), total(F.col("mask") == F.col("here")).alias("unique_fails"),
        total(~gone & fails, "good").alias("good_lost"), total(~gone & fails, "toxic").alias("toxic_lost"), total(fails, share).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``interactions`` of all ``docs`` (doc_id, text, lang), with what ``labels`` (doc_id, quality, toxic) says of them.

    A null lang is the empty string; other columns play no part. A doc_id is good or toxic if any of its labels says so;
    labels of no document are ignored. Every row counts, repeated ones too, and those of one doc_id are no copies of each
    other. An empty table gives no rows.
    """
    return interactions(mask_counts(docs, labels, rules))
