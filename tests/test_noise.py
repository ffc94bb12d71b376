"""Noise of code changes by language, and the pruning of the similarity join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import noise
from orrery.operators import retrieval as r
from orrery.plans.ingest_queries import CHANGES


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("typescript", 'a = "// no" // yes', 'a = "// no" '), ("typescript", "a = `x /* ${b} */`/* c */;", "a = `x /* ${b} */`;"), ("typescript", r"s = 'it\'s // in' // out", r"s = 'it\'s // in' "),
        ("typescript", "/* open", ""), ("python", "d = '''# in\n''' # out\nx", "d = '''# in\n''' \nx"), ("python", "a // b", "a // b"), ("go", "s := `a // b` // c", "s := `a // b` "),
        ("rust", "let c = '\"'; // q", "let c = '\"'; "), ("kotlin", 'v = """ // in """ // out', 'v = """ // in """ '), (None, "a // b", "a "), ("typescript", None, None),
    ],
)
def test_scanner(spark, language, text, want):
    row = spark.createDataFrame([(text, language)], "t string, l string").select(noise.without_comments(F.col("t"), F.col("l"))).first()
    assert row[0] == want


def test_reasons(spark):
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CHANGES)], "i int, language string, old string, new string")
    assert {x.i: x.reason for x in noise.noise(rows).collect()} == {i: c[3] for i, c in enumerate(CHANGES)}


def brute(left, right, least):
    u = lambda v: np.asarray(v, float) / (np.linalg.norm(v) or 1)
    return {(a, b) for a, v in left for b, w in right if a != b and len(v) == len(w) and u(v) @ u(w) >= least}


def test_cells_far_apart_never_meet(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.1 * rng.normal(size=16)).tolist()) for i in range(600)] + [(600, [0.0] * 16), (601, [1.0] * 4), (602, [1.0, 1.0, 1.0, 1.1])]
    seen = []
    monkeypatch.setattr(r, "near_cells", lambda a, b, p, x, f=r.near_cells: seen.append((len(a) * len(b), out := f(a, b, p, x))) or out)
    frame = spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)
    for least in (0.9, 0.3, -0.2):
        got = r.similar_pairs(frame, frame, least, block=25).collect()
        assert len(got) == len({(x.a, x.b) for x in got}) and {(x.a, x.b) for x in got} == brute(rows, rows, least)
    every, met = seen[0]
    assert len(met) < every / 2  # at 0.9 most pairs of cells are skipped
    top = r.similar_pairs(frame, frame, 0.5, top=3, block=25).collect()
    assert max(sum(x.a == i for x in top) for i in range(600)) == 3
