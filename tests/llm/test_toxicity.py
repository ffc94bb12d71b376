import random
import zlib

import pytest

from orrery.llm.toxicity import Model, reject_toxic, toxicity


@pytest.fixture(scope="module")
def cases(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice(["la", "mo", "ne", "ti", "su", "ra"]) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(900):
        sentences = [" ".join(word() for _ in range(r.randint(3, 12))) for _ in range(r.randint(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(1, 3)):
                k = r.randrange(len(sentences))
                sentences[k] += " " + r.choice(["vilwort", "blechkopf", "GARSTIG", "schuftig"])
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "vilwort vilwort."), (1002, "la mo. " * 5000), (1003, "... !!"), (0, rows[0][1])]
    labels += [(1, 1, 0), (None, 1, 1), (5000, 0, 1), (7, None, None)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels[:900]}


def test_held_out_accuracy(docs, cases):
    rows, labels, truth = cases
    got = toxicity(docs(rows), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    test = [r for r in got if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in test) / len(test)
    assert right > 0.95
    for r in test:  # the offending sentences are those with the words
        if r.predicted and truth[r.doc_id] and r.offending:
            s = [x for x in rows[r.doc_id][1].lower().split(".") if x.strip()]
            assert all(any(w in s[k] for w in ("vilwort", "blechkopf", "garstig", "schuftig")) for k in r.offending)
    by = {r.doc_id: r.score for r in got}
    assert by[1000] == by[1001] == by[1003] == 0.0


def test_labels_of_held_out_rows_are_not_used(docs, cases):
    from pyspark.sql import functions as F

    rows, labels, _ = cases
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    lies = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({(r.doc_id, r.score) for r in toxicity(docs(rows), x).collect()} for x in (labels, lies))
    assert one == two


def test_reject(docs, cases):
    rows, labels, truth = cases
    frame = docs(rows)
    kept = reject_toxic(frame, labels)
    assert kept.columns == frame.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len([i for i in truth if truth[i] and i in ids]) < 15
    assert len([i for i in truth if not truth[i] and i not in ids]) < 15


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxicity(docs([(1, "vilwort")]), none).collect()] == [0]
    assert toxicity(docs([]).filter("false"), none).collect() == []
    assert Model(-30.0, {}).score("a b. c")[1] == []


def test_score_against_a_plain_loop():
    import math
    import re

    from orrery.llm.toxicity import features

    r = random.Random(4)
    m = Model(-2.0, {f: r.uniform(-2, 3) for w in ("vil", "wort", "mora", "nesula") for f in features(w)})
    for _ in range(60):
        text = "".join(r.choice(["Vil", "wort", "mora", " ", " ", ". ", "!", "\n", "NESULA", "İ", "ß", "9_"]) for _ in range(r.randint(0, 60)))
        clean, bad = 1.0, []
        for s in re.finditer(r"[^.!?\n]+", text):
            words = set(re.findall(r"\w+", "".join(c.lower() if len(c.lower()) == 1 else c for c in s[0])))
            if words:
                p = 1 / (1 + math.exp(-(m.bias + sum(m.weights.get(f, 0.0) for w in words for f in features(w)))))
                clean *= 1 - p
                if p >= 0.5:
                    bad.append(s.span())
        score, _, spans = m.score(text)
        assert abs(score - (1 - clean)) < 1e-9 and spans == bad


def test_gradient_against_differences():
    import numpy as np

    from orrery.llm.toxicity import bags_of, loss

    r = np.random.default_rng(2)
    b = bags_of([("aa bb. cc aa", 1), ("bb. bb cc! dd", 0), ("dd dd ee", 1), ("... !", 1), ("aa", 0)])
    assert b.label.tolist() == [1, 0, 1, 0] and len(b.bag) == 7
    w = r.normal(size=len(b.words) + 1)
    value, grad = loss(w, b, b.inst, b.word, 0.01)
    for i in range(len(w)):
        step = np.zeros_like(w)
        step[i] = 1e-6
        slope = (loss(w + step, b, b.inst, b.word, 0.01)[0] - loss(w - step, b, b.inst, b.word, 0.01)[0]) / 2e-6
        assert abs(slope - grad[i]) < 1e-6


def test_words_behind_many_clean_ones_are_learnt(spark, docs):
    """The sentence that earns the label stands after 25,000 characters of each toxic text."""
    r = random.Random(9)
    clean = lambda: ". ".join(" ".join(r.choice(["la", "mo", "ne", "ti", "su", "ra"]) + r.choice(["la", "mo", "ne"]) for _ in range(8)) for _ in range(900))
    rows = [(i, clean() + (". you vilwort" if i % 2 else ". you mora")) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity(docs(rows), labels).collect()}
    assert sum(got[i].predicted == i % 2 for i in range(60)) > 55
    assert all(rows[i][1][a:b] == " you vilwort" for i in range(1, 60, 2) for a, b in got[i].spans)


def test_reject_odd_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x"), (3, "x"), (4, "w " * 30_000)]
    assert sorted(map(str, (x.doc_id for x in reject_toxic(docs(rows), none).collect()))) == sorted(map(str, (i for i, _ in rows)))
    assert reject_toxic(docs([]).filter("false"), none).collect() == []
