import math
import random
from hashlib import sha256

import numpy as np
import pytest

from orrery.llm.vector_codes import ENTRIES, Books, cuts, distances, scan, vector_codes, whole

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, at int, error string, label_error string"


def brute(rows):
    """[(vec_id, code, error, label_error, digest)] of (vec_id, vector, label) of one length, by plain loops over whole numbers."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    ints = [[math.floor(256 * float(np.float32(x))) if abs(x) < 2**60 else 256 * int(np.float32(x)) for x in v] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, [float(x) for x in kept[k][1]]))[:64]
    d = len(ints[0])
    books = [[ints[k][i:j] for k in order] for i, j in cuts(d)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((dist(x[i:j], c), e) for e, c in enumerate(books[p])) for p, (i, j) in enumerate(cuts(d))] for x in ints]
    for _ in range(2):
        at = assign()
        for p, (i, j) in enumerate(cuts(d)):
            for e in range(len(books[p])):
                mine = [x[i:j] for x, a in zip(ints, at, strict=True) if a[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = sha256(",".join(str(v) for b in books for r in b for v in r).encode()).hexdigest()
    at = assign()
    errors = [sum(s for s, _ in a) for a in at]
    by = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by[label] = by.get(label, 0) + e
    fit = lambda n: n if n < 2**63 else None
    whole_by = {k: None if any(x[2] == k and e >= 2**63 for x, e in zip(kept, errors, strict=True)) else fit(n) for k, n in by.items()}
    return [(i, "".join(f"{e:02x}" for _, e in a), fit(err), whole_by[label], digest) for (i, _, label), a, err in zip(kept, at, errors, strict=True)]


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture
def ask(spark):
    def run(rows):
        frame = spark.createDataFrame([(*r, "a", "b", 1, "c", "d") for r in rows], SCHEMA).repartition(3)
        return order(vector_codes(frame).collect())

    return run


def vectors(n, d, seed=1, scale=1.0):
    r = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in r.normal(0, scale, d)], int(i % 4) or None) for i in range(n)]


def test_odd_rows(ask):
    rows = vectors(300, 32)
    rows += [(None, rows[5][1], 1), (7, rows[9][1], 2), (7, rows[9][1], 2), (1000, None, 1), (1001, [None] * 32, 1), (1002, [float("nan")] * 32, None), (1003, [float("inf")] * 32, 1), (1004, [0.0] * 32, None)]
    assert ask(rows) == order(brute(rows)) and len(ask(rows)) == 304


def test_ties_and_few_rows(ask):
    r = random.Random(2)
    few = [(i, [r.choice([0.0, 1 / 256, -1 / 256]) for _ in range(16)], 1) for i in range(20)]
    many = [(i, [r.choice([0.0, 1 / 256, -1 / 256, 0.5]) for _ in range(32)], i % 3) for i in range(200)]
    assert ask(few) == order(brute(few)) and ask(many) == order(brute(many))
    one = [(3, [0.5] * 64, None)]
    assert ask(one) == order(brute(one))
    assert ask([]) == [] and ask([(1, None, 1)]) == []


def test_lengths(ask):
    """Each length has its own codebooks; labels are summed over all; 5 and 20 are not multiples of 16; empty vectors are vectors."""
    groups = [[(1000 * k + i, v, k) for i, v, _ in vectors(90, d, d)] for k, d in enumerate((0, 5, 16, 20))]
    assert ask([r for g in groups for r in g]) == order([r for g in groups for r in brute(g)])


def test_large_components(ask):
    rows = [(i, [x * 10.0 ** (i % 12) for x in v], label) for i, v, label in vectors(120, 16, 3)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert ask(rows) == order(brute(rows))
    rows += [(500, [3e38] * 16, 9), (501, [-3e38] * 16, 9)]
    assert ask(rows) == order(brute(rows))


def test_bounds_keep_scans_away_and_results_whole():
    """Refined assignments are those of full scans, ties included, and most rows need no scan."""
    r = np.random.default_rng(5)
    x = whole(r.normal(0, 1, (4000, 4)) + 6 * r.integers(0, 4, (4000, 1)))
    old = np.unique(x, axis=0)[:: len(np.unique(x, axis=0)) // ENTRIES][:ENTRIES].copy()
    at, near, far = scan(x, old)
    for moves in (3, 1, 0):
        new = old + r.integers(-moves, moves + 1, old.shape)
        new[1] = new[0]  # a tie for all near it
        at, near, far, scanned = Books([new], [old]).refine(0, x, at, near, far)
        d = distances(x, new)
        assert (at == d.argmin(1)).all()
        root = np.sqrt(d.astype(float))
        assert (near >= root[np.arange(len(x)), at]).all()
        root[np.arange(len(x)), at] = np.inf
        assert (far <= root.min(1)).all()
        old = new
    assert scanned < len(x) / 4
