"""Interactions of filters against a walk over all orders, and scans of bytes against plain counts."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from barquill.llm import audit
from barquill.llm.words import words_of, bytes_of

TEXT = st.one_of(st.none(), st.text(alphabet="aAbB é\n\t#$ü\x00\x85漢x", max_size=60), st.lists(st.sampled_from(["w" * 7, "w" * 8, "w" * 9, "w" * 17, "v" * 16 + "w", "A", "é#"])).map(" ".join))


def plain(text):
    text = text or ""
    words = text.encode().split()
    return len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), sum(c in "#$%&*|" for c in text), len(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=12), st.integers(1, 64))
def test_scan_like_plain_counts(texts, size):
    got = audit.scan(pa.array(texts, pa.string()), "#$%&*|", size)
    assert [tuple(x) for x in got.T.tolist()] == [plain(t) for t in texts]


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    words = words_of(*bytes_of(pa.array(["a b a c", "longer-than-eight longer-than-nine! a", ""])))
    monkeypatch.setattr(type(words), "hashes", lambda self: np.zeros(len(self.start), np.uint64))
    assert audit.distinct_words(words).tolist() == [3, 3, 0]


def brute(docs, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    rows = []
    for doc_id, text, lang in docs:
        words, distinct, capitals, symbols, points = plain(text)
        fails = {"A": words < 100, "B": 100 * distinct < 80 * words, "C": 100 * capitals > 10 * points, "D": symbols > 0, "E": doc_id is not None and doc_id > first[text or ""]}
        rows.append((lang or "", {f for f in fails if fails[f]}, doc_id in good, doc_id in toxic))
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] and bool(r[1] & set(order[: step - 1])) for r in rows if r[0] == part)
                unique = sum(r[1] == {f} for r in rows if r[0] == part)
                left = [r for r in left if f not in r[1]]
                out[part, "".join(order), step] = [len(left), len(gone), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {(p, o, s): (*v, total[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_like_a_walk_over_all_orders(spark):
    rng = np.random.default_rng(2)
    pool = [None, "", "  ", "#", "ABC def", " ".join(f"w{i}" for i in range(150)), "same " * 120, "UP " * 40 + " ".join(f"x{i}" for i in range(99)), "one two", " ".join(f"w{i}" for i in range(150)) + " $"]
    docs = [(int(i), pool[rng.integers(len(pool))], [None, "", "en", "fr"][rng.integers(4)]) for i in rng.permutation(80)]
    docs += [docs[0], docs[0], (None, "one two", "en"), (None, "one two", "en"), (None, "same " * 120, None), (5, "other", "fr")]
    labels = [(i, [0, 1, None][i % 3], [0, 1][i % 2]) for i in range(0, 90, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, "a", 1) for d in docs], "doc_id long, text string, lang string, mask string, n long").repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit.filter_audit(frame, known).collect()}
    assert got == brute(docs, labels)


def test_failures_keep_other_columns_and_empty_tables(spark):
    frame = spark.createDataFrame([("A#", 3, 4)], "text string, audit_failed int, audit_counts_ int")
    row = audit.with_failures(frame).first()
    assert row.audit_failed == 1 + 4 + 8 and row.audit_counts_ == 4 and row.audit_counts.symbols == 1
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.filter_audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
