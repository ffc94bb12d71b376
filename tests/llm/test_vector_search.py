import math

import numpy as np
import pytest

from orrery.llm.vector_search import neighbours


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, 3) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double, list int").repartition(3)


def brute(rows, queries, k=5):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in ok:
        if q in queries:
            found = {(-round(float(y @ x / np.sqrt(x @ x) / np.sqrt(y @ y)), 9), i) for i, y in ok if i != q}
            out[q] = sorted(found)[:k]
    return out


def check(got, want, least):
    hit = total = 0
    for q, best in want.items():
        mine = sorted(((r.rank, r.vec_id, round(r.score, 9)) for r in got if r.query_id == q))
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert len(mine) == len(best)
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        hit += len({m[1] for m in mine} & {i for _, i in best})
        total += len(best)
    assert {r.query_id for r in got} <= set(want)
    assert hit >= least * total


def test_recall_on_random_and_clustered_vectors(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 16))
    v = np.concatenate([r.normal(size=(1500, 16)), centres[r.integers(0, 20, 1500)] + 0.1 * r.normal(size=(1500, 16))]).astype(np.float32)
    rows = list(enumerate(v.tolist()))
    frame = table(spark, rows)
    check(neighbours(frame, frame.filter("vec_id % 50 = 0")).collect(), brute(rows, set(range(0, 3000, 50))), 0.93)


def test_odd_vectors_and_hot_copies(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(100)]
    rows += [(i, [1.0] * 8) for i in range(100, 400)]  # one common vector
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [float("inf")] + [1.0] * 7), (404, [None] + [1.0] * 7), (405, []), (None, [1.0] * 8), (406, [1.0] * 7)]
    rows += [(50, rows[50][1]), (450, [2.0] * 8)]
    frame = table(spark, rows)
    want = brute([x for x in rows if x[0] != 406], set(range(0, 500, 50)))
    got = neighbours(frame, frame.filter("vec_id % 50 = 0")).collect()
    check(got, want, 0.99)
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 100] == [101, 102, 103, 104, 105]


def test_few_rows(spark):
    frame = table(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])])
    got = neighbours(frame, frame.filter("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 6)) for r in got] == [(1, round(0.5**0.5, 6)), (2, 0.0)]
    assert neighbours(frame.filter("false"), frame).collect() == []
    assert neighbours(frame, frame.filter("false")).collect() == []


def test_components_whose_squares_leave_the_doubles(spark):
    r = np.random.default_rng(8)
    v = r.normal(size=(120, 6))
    sizes = [1e200, 1e-200, 1e307, 1.0]
    rows = [(i, (v[i] * sizes[i % 4]).tolist()) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = neighbours(frame, frame.filter("vec_id % 10 = 0")).collect()
    check(got, brute([(i, v[i].tolist()) for i in range(120)], set(range(0, 120, 10))), 0.95)


def test_lengths_and_ids_with_several_vectors(spark):
    r = np.random.default_rng(9)
    rows = [(i, r.normal(size=6).tolist()) for i in range(60)] + [(i, r.normal(size=4).tolist()) for i in range(100, 130)]
    rows += [(7, r.normal(size=6).tolist()), (7, [0.5, 0.5, 0.5, 0.5, 0.5, 0.4]), (7, [0.5, 0.5, 0.5, 0.5, 0.4, 0.5]), (50, [0.5] * 6), (0, r.normal(size=6).tolist())]
    frame = table(spark, rows)
    got = neighbours(frame, frame.filter("vec_id % 50 = 0")).collect()
    for q in (0, 50, 100):
        best = {}
        for i, x in rows:
            for j, y in rows:
                if i == q != j and len(x) == len(y):
                    x, y = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
                    best[j] = max(best.get(j, -2), round(float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)), 9))
        mine = [(x.vec_id, round(x.score, 9)) for x in sorted(got, key=lambda x: x.rank) if x.query_id == q]
        assert mine == sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_queries_from_sparse_regions(spark, seed):
    """Ten tight clusters and 60 vectors far from them, which ask: few samples are like them, none is cut short."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(10, 32))
    v = np.concatenate([np.repeat(centres, 250, 0) + 0.05 * r.normal(size=(2500, 32)), r.normal(size=(60, 32))]).astype(np.float32)
    rows = [(i if i < 2500 else 10_000 + i, x) for i, x in enumerate(v.tolist())]
    frame = table(spark, rows)
    got = neighbours(frame, frame.filter("vec_id >= 10000")).collect()
    check(got, brute(rows, {i for i, _ in rows if i >= 10_000}), 0.95)
    assert len(got) == 300
