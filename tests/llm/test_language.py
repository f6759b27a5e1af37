"""Languages of held-out texts, hierarchies with more than two languages, and odd texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from barquill.llm import language
from barquill.llm.queries import QUERIES


def test_held_out_texts(spark):
    got = QUERIES["op11_hierarchical_language_id"](spark, "/root/testdata/sf0.1").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs) and both.score.between(0, 1).all()
    held = both[both.held_out]
    assert 0.2 < len(held) / len(both) < 0.3
    assert (held.lang == held.lang_pred).mean() > 0.995
    for _, part in held.groupby("lang"):
        assert (part.lang == part.lang_pred).mean() > 0.98


def made_up(rng, lang, n):
    """Words of an invented language: languages of one family share two thirds of their syllables."""
    family, own = lang[:2], lang
    seeds = [np.random.default_rng(sum(map(ord, x)) * 7) for x in (family, family + family, own)]
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäöéñ"))
    syllables = ["".join(s.choice(letters, 3)) for s in seeds for _ in range(30)]
    return " ".join("".join(rng.choice(syllables, 2)) for _ in range(n))


def test_families_of_three_and_single_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "family_of", lambda lang: lang[:2])
    rng = np.random.default_rng(1)
    langs = ["aa1", "aa2", "aa3", "bb1", "bb2", "cc"]
    rows = [(made_up(rng, lang, 40), lang) for lang in langs for _ in range(60)]
    rows += [(None, "aa1"), ("", "bb1"), ("123 !?", "cc"), ("abc", None)]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    assert {k: v for k, v in model.families.items()} == {"aa": ["aa1", "aa2", "aa3"], "bb": ["bb1", "bb2"], "cc": ["cc"]}
    assert set(model.of_pair) == {("aa1", "aa2"), ("aa1", "aa3"), ("aa2", "aa3"), ("bb1", "bb2")}
    texts = [(made_up(rng, lang, 25), lang) for lang in langs for _ in range(40)]
    found, scores = model.predict(pa.array([t for t, _ in texts]))
    assert np.mean([a == b for a, (_, b) in zip(found, texts, strict=True)]) > 0.97 and scores.min() >= 0 and scores.max() <= 1
    for i in (0, 100, 239):  # a text's answer is its own, whatever stands beside it
        one, score = model.predict(pa.array([texts[i][0]]))
        assert one[0] == found[i] and score[0] == scores[i]


def test_odd_texts_and_columns(spark):
    rows = [(i, f"der die das und nicht {i} wort" if i % 2 else f"the and of with that {i} word", "de" if i % 2 else "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    odd = [(1, None), (2, ""), (3, "12 -- !"), (4, "the and of that"), (None, "die und das"), (4, "the and of that"), (5, "漢字"), (6, "the and " * 50_000)]
    got = language.with_language(spark.createDataFrame([(*r, 7) for r in odd], "doc_id long, text string, language_found int"), model).collect()
    said = [(r.language, r.language_found) for r in got]
    assert said[:6] == [("und", 7)] * 3 + [("en", 7), ("de", 7), ("en", 7)] and said[6][0] in ("de", "en") and said[7][0] == "en"
    assert all(r.language_score == 0 for r in got[:3])
    assert language.with_language(docs.where("false"), model).count() == 0
    empty = language.train(docs.where("false"))
    assert {r.language for r in language.with_language(docs, empty).collect()} == {"und"}
    single = language.train(docs.where("lang = 'en'"))
    assert {(r.language, r.language_score) for r in language.with_language(docs, single).collect()} == {("en", 1.0)}


def test_family_codes():
    assert language.family_of("pt-BR") == language.family_of("es") == "romance" and language.family_of("xx") == "xx"
