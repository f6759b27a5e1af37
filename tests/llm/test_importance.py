"""Importance resampling against a plain count of all features."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from barquill.llm import importance

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


def features(text, order):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return len(words), [b" ".join(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, order, buckets, percent, min_words):
    have, want = Counter(), Counter()
    for _, text in docs:
        have.update(zlib.crc32(f) % buckets for f in features(text, order)[1])
    for text in target:
        want.update(zlib.crc32(f) % buckets for f in features(text, order)[1])
    s, t = sum(have.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((have[b] + 1) * (t + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        n, found = features(text, order)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = place
    return rows


@pytest.fixture(scope="module")
def docs():
    texts = [None, "", "?!", "One two THREE", "é漢 Ünder_score under-score x\x00y", LONG, LONG + " end", "a b " * 40]
    return [(i, texts[i % len(texts)] if i < 16 else " ".join(f"w{(i * j) % 50}" for j in range(10 + i % 30))) for i in range(200)] + [(None, "a b " * 40), (None, None), (150, "q r s " * 9)]


@pytest.mark.parametrize("order", [1, 3])
def test_like_a_plain_count(spark, docs, order, monkeypatch):
    monkeypatch.setattr(importance, "NODES", 500)
    target = ["a b c d", None, "w1 w2 w3 w1 w2 w3", LONG[:400]]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, resample_found string").repartition(4)
    want = spark.createDataFrame([(t,) for t in target], "text string")
    gains = importance.gains_of(frame, want, order, 700)
    scored = importance.with_scores(frame, gains, order)
    got = [tuple(r) for r in importance.ranked(scored, 30, 20).select("doc_id", *importance.MADE, "resample_rank").collect()]
    rows = brute(docs, target, order, 700, 30, 20)
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in rows)
    drawn = importance.resample(frame, want, 30, 20, order, 700)
    assert drawn.columns == ["doc_id", "text", "resample_found", *importance.MADE]
    assert sorted(str(tuple(r)) for r in drawn.select("doc_id", *importance.MADE).collect()) == sorted(str(tuple(r[:5])) for r in rows if r[5])


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 20])
@pytest.mark.parametrize("order", [1, 2, 4])
def test_slices_have_every_feature_once(size, order):
    texts = [None, "a b c d e f g", "", "h", "--", "i j " * 30, "k" * 50]
    found = [Counter() for _ in texts]
    for words, text, old in importance.slices(pa.array(texts), order, size):
        trie = importance.Trie(order)
        for depth, nodes, owner in trie.walk(words, text, old):
            for node, i in zip(nodes.tolist(), owner.tolist(), strict=True):
                found[i][depth.states[node]] += 1
    assert found == [Counter(zlib.crc32(f) for f in features(t, order)[1]) for t in texts]


def test_empty_tables(spark):
    none, text = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("a b",)], "text string")
    assert importance.resample(none, text).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert importance.resample(one, none.select("text"), min_words=1).count() == 0
    assert importance.resample(one, none.select("text"), percent=100, min_words=1).first().doc_id == 1
