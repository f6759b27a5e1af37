"""A corpus made ready for training: five stages, each reading the table that the one before wrote."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquill.llm.minhash import near_duplicates, with_keys
from barquill.llm.mixing import mix_sources
from barquill.llm.names import others, unused
from barquill.llm.packing import pack
from barquill.llm.pii import replace_pii
from barquill.llm.quality import grade, ratings_of, train
from barquill.llm.queries import surrogate_key
from barquill.functions.tables import materialize, new_path


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _making(*names: str) -> Callable[[Stage], Stage]:
    """A stage that makes columns of these names for itself: columns of documents that are called so stay as they are."""

    def wrap(stage: Stage) -> Stage:
        @functools.wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            clash = [c for c in docs.columns if c.lower() in names]
            aside = unused([*docs.columns, *names], *clash)
            done = stage(spark, docs.withColumnsRenamed(dict(zip(clash, aside, strict=True))), sf_dir)
            return done.withColumnsRenamed(dict(zip(aside, clash, strict=True)))

        return run

    return wrap


@_making("quality_grade", "quality_tail", "quality_kept")
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose highest grade is likely; the model is fitted on the ratings of the documents that came in."""
    model = train(docs, ratings_of(spark.read.parquet(f"{sf_dir}/labels.parquet")), grades=3)
    return grade(docs, model).where("quality_kept").select(*others(docs.columns))


@_making("near_id", "k1", "k2")
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): that with the smallest doc_id.

    Repeated rows become one; documents without words are no duplicates. Rows that share a doc_id are told apart by their
    texts. Those without one count as the largest, by a hash of the text, and stay without; if they have no words, all stay.
    """
    words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    unnamed = F.col("doc_id").isNull() & ~words
    late = F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62))
    rows = docs.where(~unnamed).withColumn("near_id", F.coalesce(F.col("doc_id").cast("long"), late))
    found = near_duplicates(rows.select(F.col("near_id").alias("doc_id"), "text"), percent=80, keys=True).withColumnRenamed("doc_id", "near_id")
    found = materialize(found, "near")
    ids = found.groupBy("near_id").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).where("kept > 0")
    once = rows.join(ids.where("n = 1").select("near_id"), "near_id", "left_semi")
    several = ids.where("n > 1").select("near_id")
    # of the texts of one doc_id that are linked, one
    verdict = found.where("kept").join(several, "near_id").withColumn("key", F.struct("k1", "k2"))
    linked = verdict.where("n_shingles > 0").groupBy("near_id", "group").agg(F.min("key").alias("key")).select("near_id", "key.k1", "key.k2")
    verdict = linked.union(verdict.where("n_shingles = 0").select("near_id", "k1", "k2").distinct())
    again = with_keys(rows.join(several, "near_id", "left_semi")).join(verdict, ["near_id", "k1", "k2"], "left_semi")
    blank = again.where(~words).dropDuplicates(["near_id", "text"])
    again = again.where(words).dropDuplicates(["near_id", "k1", "k2"]).union(blank)
    return once.select(*others(docs.columns)).union(again.select(*others(docs.columns))).union(docs.where(unnamed))


@_making("pii_text", "pii_entities")
def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; n_chars follows the text."""
    done = replace_pii(docs, surrogate_key(spark))
    changed = {"text": F.col("pii_text"), "n_chars": F.when(F.size("pii_entities") > 0, F.length("pii_text").cast("long")).otherwise(F.col("n_chars"))}
    return done.select(*(changed[c].alias(c) if c in changed else name for c, name in zip(docs.columns, others(docs.columns), strict=True)))


@_making("mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_copy")
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mix_sources(docs).where("mix_copies > 0")
    return mixed.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), "mix_copies"))).select(*others(docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Documents that a task sends to its Python process at once; an executor holds two copies of a batch for each of its cores.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Stages run inside send documents to Python in small batches, unless the session asks for smaller ones; the setting is put back."""
    old = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(int(old), BATCH_ROWS) if int(old) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, old)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = new_path(spark, "corpus")
    with small_batches(spark):
        for name, stage in STAGES:
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{top}/{name}")
            docs = spark.read.schema(out.schema).parquet(f"{top}/{name}")
    return docs


#: Fitted weights, surrogates and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
