"""The pipeline's stages on odd documents, surrogates over a corpus whose persons are known, grades on held-out texts."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barquill.llm import chat, minhash, pii, quality, substrings, words
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ODD = [(1, None), (1, None), (2, ""), (3, " \n"), (4, "one two three four five six"), (4, "one two three four five six"), (4, "quite another text under the same number"), (5, LONG), (6, LONG + " end"), (None, "a text without a number of its own"), (7, "Mr John Smith, john@mail.example.org"), (8, "One two three four five six")]
CLASH = ["near_id", "k1", "k2", "kept", "n", "component_id", "quality_kept", "quality_rated", "pii_text", "pii_done", "mix_size", "mix_copies", "mix_copy", "step", "rank", "start", "length", "ids", "a.`b"]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame([(i, t, None, None if n % 3 else f"s{n % 2}", None) for n, (i, t) in enumerate(ODD)], SCHEMA).repartition(3)
    for n, name in enumerate(CLASH):
        docs = docs.withColumn(name, F.lit(n))
    return docs


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_documents(spark, odd, name):
    """Every stage takes nulls, blank and very long texts, repeated rows and ids, no rows at all, and columns named like its own."""
    stage = dict(corpus_pipeline.STAGES)[name]
    done = stage(spark, odd, DATA)
    rows = done.collect()
    none = stage(spark, odd.limit(0), DATA)
    assert none.columns == done.columns and none.count() == 0
    if name == "packing":
        assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
        return
    assert done.columns == odd.columns
    assert all([r[c] for c in CLASH] == list(range(len(CLASH))) for r in rows)
    texts = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in rows)
    given = sorted((i if i is not None else -1, t or "") for i, t in ODD)
    if name == "quality":
        assert not set(texts) - set(given)
    if name == "near_dedup":
        want = {(2, ""), (3, " \n"), (4, ODD[4][1]), (4, ODD[6][1]), (5, LONG), (-1, ODD[9][1]), (7, ODD[10][1])}
        assert set(texts) - {(1, "")} == want and len(texts) == len(want) + 1  # repeated rows become one
    if name == "pii":
        changed = [(i, t) for i, t in texts if (i, t) not in given]
        assert len(texts) == len(given) and len(changed) == 1 and changed[0][0] == 7 and "Smith" not in changed[0][1]
    if name == "mixing":
        assert not set(texts) - set(given) and len(texts) <= 2 * len(given)


def test_pipeline_without_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_deduplication_of_no_rows_and_clashing_columns(spark, odd):
    assert minhash.near_duplicates(odd.limit(0)).count() == 0 and substrings.remove_repeats(odd.limit(0)).count() == 0
    clash = odd.select("doc_id", "text", *(F.lit(1).alias(c) for c in ("n_shingles", "component_id", "band", "node", "n_words", "chunk", "body", "n", "kept")))
    assert minhash.near_duplicates(clash).count() == substrings.remove_repeats(clash).count() == len(ODD)


def test_many_equal_rows_come_back(spark):
    text = " ".join(f"v{i}" for i in range(40))
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    got = substrings.remove_repeats(rows, texts=False)
    assert got.count() == 3000 and got.where("n_removed = 0").count() == 1 and got.where("n_removed = 40").count() == 2999


def test_very_long_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "<s>" * 400_000), (1, 1, "assistant", "x" * 2_000_000), (1, 2, "user", "")], "conv_id long, turn long, role string, text string")
    done = chat.format_chat(turns)
    got = done.select(F.length("formatted").alias("n"), chat.read_chat(F.col("formatted")).alias("turns"), F.length(chat.read_loss(F.col("formatted"), F.col("loss_spans"))).alias("loss")).first()
    assert [len(t.text) for t in got.turns] == [1_200_000, 2_000_000, 0] and got.loss == 2_000_000 and got.n > 3_200_000


KEY = b"of a corpus"
TITLES = {"m": ["Mr", "Mr.", "Herr", "Señor", "Dr."], "f": ["Mrs", "Ms.", "Frau", "Señora", "Dr."]}
CLEAN = ["The meeting of 2024-01-31 began at 10:20:30 in room 12.3.4.", "Sales rose by 1,234.56 to 99 % of plan.", "Version 2.0 replaced 1.9.17 on the server.", "Smithfield and the blacksmith are no persons.", "ISBN 978-3-16-148410-0 costs 12.50.", "See pages 100-120 and tables 3/4."]


def corpus(seed=1, persons=400, docs=300):
    """Texts, and for each the entities put into it: (kind, identity, text)."""
    rng = random.Random(seed)
    syllable = lambda: rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou")
    family = sorted({(syllable() + syllable() + rng.choice(["n", "r", "l", "ck", "son"])).title() for _ in range(persons)})
    people = [(rng.choice("mf"), f) for f in family for _ in range(rng.choice([1, 1, 2]))]
    people = sorted({(g, rng.choice(pii.GIVEN[("latin", g)]), f) for g, f in people})
    out = []
    for _ in range(docs):
        parts, told = [rng.choice(CLEAN)], []
        for g, given, name in rng.sample(people, 3):
            parts.append(f"{rng.choice(TITLES[g])} {given} {name} wrote.")
            told.append(("name", (given, name), f"{given} {name}"))
            if rng.random() < 0.5:
                parts.append(f"Then {given} {name} left.")
                told.append(("name", (given, name), f"{given} {name}"))
            mail = f"{given}.{name}@mail{rng.randrange(20)}.example.com".encode("ascii", "ignore").decode().lower()
            parts.append(f"Mail to {mail} please.")
            told.append(("email", mail, mail))
        phone, ip = f"+1 ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(10_000):04d}", ".".join(str(rng.randrange(1, 255)) for _ in range(4))
        ssn, card = f"{rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card += next(d for d in "0123456789" if pii.luhn(card + d))
        for kind, x, frame in (("phone", phone, "Call {} now."), ("ip", ip, "Host {} is up."), ("ssn", ssn, "His number {} is known."), ("card", card, "Pay {} at once."), ("secret", f"k{rng.randrange(10**9):09d}", "password = {} works")):
            parts.append(frame.format(x))
            told.append((kind, x, x))
        parts.append(rng.choice(CLEAN))
        out.append((" ".join(parts), told))
    return out


def test_surrogates_of_a_corpus_whose_entities_are_known():
    """All entities are found and nothing else; each identity has one surrogate everywhere, and no two share one."""
    made, back, found, put, false = {}, {}, {}, {}, 0
    for text, told in corpus():
        new, entities = pii.replace(text, KEY)
        left = [(e["kind"], text[e["start"] : e["end"]], e["surrogate"]) for e in entities]
        for kind, identity, said in told:
            put[kind] = put.get(kind, 0) + 1
            hit = next((x for x in left if x[0] == kind and x[1] == said), None)
            if hit is None:
                continue
            left.remove(hit)
            found[kind] = found.get(kind, 0) + 1
            assert made.setdefault((kind, identity), hit[2]) == hit[2]
            assert back.setdefault((kind, hit[2]), identity) == identity
            assert hit[2] != said and not re.search(rf"(?<!\w){re.escape(said)}(?!\w)", new)
        false += len(left)
    recall = {k: found.get(k, 0) / n for k, n in put.items()}
    assert all(r == 1.0 for r in recall.values()), recall
    assert false <= 0.002 * sum(put.values())


def plain_fit(x, y, grades, rounds=400, rate=0.5, shrink=1e-3):
    """A cumulative-link model by plain gradient steps on dense features."""
    w, theta = np.zeros(x.shape[1]), np.linspace(-1, 1, grades - 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(theta[None, :] - (x @ w)[:, None], -30, 30)))
        full = np.concatenate([np.zeros((len(y), 1)), p, np.ones((len(y), 1))], axis=1)
        up, low = full[np.arange(len(y)), y + 1], full[np.arange(len(y)), y]
        likely = np.maximum(up - low, 1e-9)
        d_up, d_low = up * (1 - up) / likely, low * (1 - low) / likely
        w += rate * (x.T @ (-(d_up - d_low)) / len(y) - shrink * w)
        step = np.array([np.sum(np.where(y == g, d_up, 0) - np.where(y == g + 1, d_low, 0)) for g in range(grades - 1)]) / len(y)
        theta = np.maximum.accumulate(theta + rate * step)
    return w, theta


def test_grades_of_texts_that_were_not_fitted(duck):
    """Fitted on four fifths of some 4000 rated texts: the rest is graded as well as by a plain fit, and most toxic texts are told apart."""
    rows = duck.execute("SELECT doc_id, text, CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    y = np.array([r[2] for r in rows])
    found = [quality.features(w) for w in words.chunks_of(pa.array([r[1] for r in rows]), 1 << 40)]
    feature, bounds = found[0]
    train = np.arange(len(y)) % 5 > 0
    some = [feature[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    fitted = quality.fit(np.concatenate([some[i] for i in np.flatnonzero(train)]), np.concatenate([[0], np.cumsum([len(some[i]) for i in np.flatnonzero(train)])]), y[train], 3)
    above = fitted.above(feature, bounds)
    dense = np.zeros((len(y), 2048))
    for i, x in enumerate(some):
        dense[i, x % 2048] = 1 / np.sqrt(len(x) or 1)
    w, theta = plain_fit(dense[train], y[train], 3)
    plain = 1 / (1 + np.exp(-np.clip((dense @ w)[:, None] - theta[None, :], -30, 30)))

    def area(score, positive):  # the chance that a positive text has the higher score
        a, b = score[positive & ~train], score[~positive & ~train]
        order = np.argsort(np.concatenate([a, b]), kind="stable")
        rank = np.empty(len(order))
        rank[order] = np.arange(1, len(order) + 1)
        return (rank[: len(a)].sum() - len(a) * (len(a) + 1) / 2) / (len(a) * len(b))

    assert area(above[:, 1], y == 2) >= max(0.95, area(plain[:, 1], y == 2) - 0.01)
    assert area(above[:, 0], y > 0) >= max(0.85, area(plain[:, 0], y > 0) - 0.01)  # poor texts may be as bad as toxic ones
    kept = above[:, 1] >= quality.KEEP
    assert kept[~train & (y == 2)].mean() > 0.97 and kept[~train & (y == 0)].mean() < 0.1
