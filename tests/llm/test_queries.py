"""The operators' queries against SQL, and, where SQL cannot express them, against brute force."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barquill.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


def test_registered():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and "pipeline" in __spark_entry__.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_packing_is_every_id_once(spark, duck):
    got = QUERIES["op2_monotone_queue_packing"](spark, DATA).toPandas()
    reader = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        ids = np.array([*reader.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = got[got.doc_id == doc_id].sort_values("start")
        assert pieces.doc_tokens.eq(len(ids)).all() and pieces.length.sum() == len(ids)
        assert (pieces.start == pieces.length.cumsum() - pieces.length).all()
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(pieces.start, pieces.length, strict=True)] == pieces.ids_crc32.tolist()
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.offset == got.groupby("sequence_id").length.cumsum() - got.length).all()
    filled = got.groupby("sequence_id").agg(n=("length", "sum"), to=("padded_to", "first"))
    assert filled.n.max() <= 2048 and ((filled.to == 2048) | (filled.to == filled.n)).all()
    assert (filled.to - filled.n).sum() < 0.02 * filled.n.sum()


def test_mixing_comes_near_its_targets(spark, duck):
    got = QUERIES["op3_systematic_mixing"](spark, DATA).toPandas().merge(duck.execute("SELECT doc_id, source FROM documents").df(), on="doc_id")
    sizes = got.groupby("source")["size"].sum()
    targets = got.groupby("source").target.first()
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes.index))}
    left, share, want = dict(sizes), 1.5 * sizes.sum(), {}
    while left:  # settle those that are over, share the rest again
        unit = share / sum(weight[s] for s in left)
        over = {s for s in left if unit * weight[s] > 2 * left[s]}
        settled = over or set(left)
        for s in settled:
            want[s] = 2 * left[s] if over else unit * weight[s]
        share -= sum(want[s] for s in settled)
        left = {s: n for s, n in left.items() if s not in settled}
    assert all(targets[s] == pytest.approx(want[s]) for s in want)
    assert (got.taken <= 2 * got["size"]).all()
    largest = got.groupby("source")["size"].max()
    assert all(abs(got[got.source == s].taken.sum() - want[s]) <= largest[s] for s in want)


def test_nearest_neighbours_are_found(spark, duck):
    got = QUERIES["op10_multi_index_hashing"](spark, DATA).toPandas()
    ids, x = zip(*duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall(), strict=True)
    ids, x = np.array(ids), np.array(x, dtype=float)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]])
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine.score, [x[ids == v][0] @ x[q] for v in mine.vec_id])
        hits, total = hits + len(best & set(mine.vec_id)), total + 20
    assert hits / total >= 0.9


def test_poor_and_toxic_texts_are_told_from_good_ones(spark, duck):
    got = QUERIES["op9_ordinal_quality"](spark, "/root/testdata/sf0.01").toPandas()
    labels = duck.execute("SELECT doc_id, quality, toxic FROM '/root/testdata/sf0.01/labels.parquet'").df()
    both = got.merge(labels, on="doc_id")
    good = (both.quality == 1) & (both.toxic == 0)
    assert both[good].kept.mean() > 0.97 and both[~good].kept.mean() < 0.15
    assert got.expected_grade.between(0, 2).all() and got.tail_probability.between(0, 1).all()


def test_pipeline_stages(spark, duck, tmp_path):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for i, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "packing":
            assert docs.columns == columns
        if name in ("quality", "near_dedup"):
            assert 0.5 * rows < docs.count() <= rows
            rows = docs.count()
        if name == "near_dedup":
            assert docs.select("doc_id").distinct().count() == rows
        if name == "pii":
            assert docs.count() == rows
        if name == "mixing":
            mixed = docs.count()
    assert docs.select("doc_id").distinct().count() <= rows and mixed > 0
    whole = docs.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).toPandas()
    assert (whole["sum(length)"] % whole["max(doc_tokens)"] == 0).all()
